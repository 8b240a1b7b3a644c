"""Conversation prefixes, main texts of pages and spelling variants against brute force, and with hard rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from radiograph.llm import articles, prefixes, spelling

TURNS = "conv_id long, turn int, role string, text string, extra string"


def rebuilt(rows):
    """Rebuilt conversations: id -> list of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}


def trie(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    name = {p: min(m) for p, m in members.items()}
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))) for p, m in members.items()}
    return sorted(
        (name[p], len(p), name[p[:-1]] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()
    )


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x") for r in rows], TURNS).withColumn("depth", F.lit(1))
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixes.prefix_trie(frame).collect())


def conversations():
    rows = []
    for c in range(70):
        kind = c % 3
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {kind}" if t < 3 + kind else f"own {c} {t}") for t in range(c % 7)]
    rows += [(200, t, "user", f"a long one {t}") for t in range(300)] + [(200, 5, "user", "a long one 5")] * 2  # spans ranges; repeated turns
    rows += [(c, 0, "user", "the same") for c in range(400, 440)]  # copies
    rows += [(-7, None, None, "x"), (-7, 1, "user", None), (None, 1, "user", "nowhere"), (500, None, "", ""), (39, 0, "user", "")]
    return rows


def test_prefix_trie(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS", 8)
    monkeypatch.setattr(prefixes, "CHAIN_BLOCK", 16)
    rows = [r for r in conversations() if r[0] is None or r[0] >= 0]
    assert trie_of(spark, rows) == trie(rows)
    assert trie_of(spark, []) == []


def test_prefix_sql(spark):
    rows = [r for r in conversations() if r[0] is not None and r[0] < 100 and r[0] >= 0]
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    got = con.execute(f"select conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({prefixes.PREFIX_SQL})").fetchall()
    assert sorted(map(tuple, got)) == trie(rows)


def test_colliding_bases(spark, monkeypatch):
    """With a base of zero all prefixes with one last turn agree: the stored turns tell, and another base is taken."""
    real = prefixes.bases
    monkeypatch.setattr(prefixes, "bases", lambda seed: (1, 1) if seed == 0 else real(seed))
    rows = [(0, 0, "user", "a"), (0, 1, "user", "b"), (0, 2, "user", "c"), (20, 0, "user", "b"), (20, 1, "user", "a"), (20, 2, "user", "c")]
    assert trie_of(spark, rows) == trie(rows)


def test_fingerprints_compose():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, prefixes.P, 1000, dtype=np.uint64) for _ in range(2))
    assert prefixes._multiplied(a, b).tolist() == [int(x) * int(y) % prefixes.P for x, y in zip(a, b, strict=True)]
    n = rng.integers(0, 1 << 40, 50)
    assert prefixes._powers(12345678901234567, n).tolist() == [pow(12345678901234567, int(k), prefixes.P) for k in n]


def variants(rows):
    counts = Counter()
    for doc, text in rows:
        word = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                word += ch.lower() if ch.isascii() else ch
            elif word:
                h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
                counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
                word = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(x, y):
        if len(x) < len(y):
            x, y = y, x
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y, strict=True)) == 1
        return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))

    form, n_near = {}, {}
    for w, n in counts.items():
        others = [(-m, o) for o, m in counts.items() if near(w, o)]
        n_near[w] = len(others)
        best = min(others, default=(0, None))
        form[w] = best[1] if best[1] and -best[0] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n, n_near[w], counts[form[w]] if form[w] else 0))
    return sorted(out)


def texts():
    words = ["abcdefgh", "abcdefg", "abcdefgx", "xbcdefgh", "abcdxefgh", "aaaaaaa", "aaaaaa", "aaaaaaaa", "Straßen", "strassen", "Àbcdef", "àbcdef", "bcdefgh"]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(1 + (k % 3 == 0) * 30 * (i % 2))) + f" common{i % 7} 中文abcdefghα") for i in range(40)]
    rows += [(None, "abcdefgh, null id"), (7, None), (8, ""), (8, "abcdefgh " * 3), (9, "prefix" + "q" * 30), (9, "short")]
    return rows + [(100 + i, " ".join(f"prefixword{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(120)) + " x" * 50) for i in range(6)]


@pytest.mark.parametrize("pairs", [4096, 3])
def test_spelling(spark, monkeypatch, pairs):
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "PIECE", 37)
    frame = spark.createDataFrame(texts(), "doc_id long, text string").withColumn("n", F.lit(1))
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in spelling.spelling_variants(frame).collect())
    assert got == variants(texts())
    assert spelling.spelling_variants(frame.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>No &amp; title</title><script>var t="</p>"; if (a<b) x();</script><style>p{}</style></head><body class="with-sidebar">
<header><h2>The site of the papers</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News of the day</a></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies on this page and that is what you have to know about it.</div>
<article><header><h1>A head&shy;line</h1></header><p>It was   the best of&nbsp;times &amp; it was the worst of times, as the old book has it.<p>So it goes.
<div class="ad">Buy this now, it is the best of all that you can have for so little of your money.</div>
<p><a href="/x">Read more of this on another page</a></p><p>This is the end of the story, which was not as long as you may have wanted it to be.<br><br>The author</p>
<section id="comments"><p>I have read this and it is the best that I have read in a long time on this page.</p></section></article>
<aside>Related: <a href=/y>other</a></aside><form><input> Subscribe to the letter of the day</form><footer>&copy; the owners of the page</footer>"""


def test_articles(spark):
    want = "A head­line\nIt was the best of times & it was the worst of times, as the old book has it.\nSo it goes.\nThis is the end of the story, which was not as long as you may have wanted it to be.\nThe author"
    assert articles.main_text(PAGE) == want
    plain = "<div id='menu'>The menu of the day is here</div><h1>Title</h1><div>It is the story of the man who was not there and of the dog that was with him at that time.</div>End.<div><a href='x'>Next</a> <a href='y'>Other pages</a></div><div class='copyright'>by us</div>"
    assert articles.main_text(plain) == "Title\nIt is the story of the man who was not there and of the dog that was with him at that time."  # "End." is as near to the links
    assert articles.main_text(plain.replace("End.", "Short.<br><br>End.")).endswith("time.\nShort.")
    assert articles.main_text("short &lt;text&gt; only") == "short <text> only" and articles.main_text("") == "" and articles.main_text("<p") == "<p" and articles.main_text("<script>x") == ""
    assert len(articles.main_text("<p>" + "the of and to in " * 200_000).split()) == 1_000_000
    assert articles.main_text('<p title="a > b">x</p>' + '<a "' * 20_000).startswith("x")
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [tuple(r) for r in articles.extract_articles(frame).collect()]
    assert got.count((1, "u", want, len(want))) == 2 and (None, None, "", 0) in got and (2, "v", "", 0) in got and len(got) == 4
    assert articles.extract_articles(frame.limit(0)).collect() == []


def test_decontamination_sql(spark, tmp_path):
    """The query and its SQL, which knows no masks, on items changed in two words, short items, null ids and repeated rows."""
    from radiograph.llm import decontamination

    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    changed = ["x", *ten[1:5], "y", *ten[6:]]
    items = [(1, " ".join(ten)), (2, "one two three four five six"), (None, " ".join(f"w{i}" for i in range(30))), (3, None), (4, ""), (5, "single")]
    texts = [
        (1, " ".join(ten)), (2, "pre " + " ".join(changed) + " post"), (3, "so ONE, two three four five six."), (None, " ".join(f"w{i}" for i in range(5, 18))), (None, "nothing of it"), (None, " ".join(changed)),
        (4, " ".join(["x", "y", "z", *ten[3:]])), (5, None), (6, ""), (7, "not single here, but a single one"), (1, " ".join(ten)), (8, " ".join(f"w{i}" for i in range(9))), (9, " ".join(f"w{i}" if i % 5 else "q" for i in range(30))),
    ]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.execute("create table benchmark(item_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    con.executemany("insert into benchmark values (?, ?)", items)
    got = decontamination.contaminated(docs, bench)
    want = con.execute(f"select {', '.join(got.columns)} from ({decontamination.CONTAMINATED_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {(1, 1), (2, 1), (3, 2), (None, None), (None, 1), (7, 5)} <= {r[:2] for r in want}


def test_pipeline_keys(spark, tmp_path):
    """Rows of scans, unions, joins and exploded rows all have keys of their own, and stages take any of them."""
    import corpus_pipeline as pipeline

    rows = [(i % 3, f"a text of some words number {i % 4} that goes on for a while", "en", "s", 1) for i in range(8)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    exploded = read.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice")
    for frame, n in ((read, 9), (read.where("doc_id > 0"), 5), (read.union(read), 18), (read.dropDuplicates(), 5), (read.join(read.select("doc_id").distinct(), "doc_id"), 8), (exploded, 18), (docs, 9), (read.limit(0), 0)):
        keyed = pipeline._keyed(frame)
        keys = [r["key"] for r in keyed.select("key").collect()]
        assert len(keys) == len(set(keys)) and (len(keys) == n or n == 5)
    spark.createDataFrame([(1, "nothing that stands in the texts above this line of words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.drop_benchmark_text(spark, read.union(read), str(tmp_path)).count() == 18
    assert pipeline.keep_one_of_each(spark, read.union(read), str(tmp_path)).count() == 4 + 2  # four texts, and rows without one


def test_secret_look_alikes():
    """Precision and recall on fresh rows, and on numbers and codes that are as long as keys."""
    import numpy as np

    from radiograph.llm import secrets

    network = secrets.trained(secrets.labelled_table() + secrets.path_table())

    def hit(rows):
        found = secrets.all_findings([a + b + c for a, b, c, _ in rows], network)
        return [any(s < len(a) + len(b) and e > len(a) for s, e, _ in spans) for (a, b, _, _), spans in zip(rows, found, strict=True)]

    fresh = secrets.labelled_table(1000, seed=321)
    told, hits = np.array([y for *_, y in fresh], bool), np.array(hit(fresh))
    own = np.array([not secrets.base_findings("".join(x[:3])) for x in fresh])  # what base patterns match is no matter of the network
    assert hits[told].mean() >= 0.97 and told[hits & own].mean() >= 0.99
    r = np.random.default_rng(8)
    like = [("some words at ", maker(), " and more words", 0) for maker in secrets.numbers_and_codes(r) for _ in range(50)]
    like += [("the book ", f"ISBN{r.integers(100, 999)}-{r.integers(100, 999)}-{r.integers(100, 999)}", " is", 0) for _ in range(100)]
    others = [x for x in like if not secrets.base_findings("".join(x[:3]))]  # long runs of digits are hexadecimal to the base
    assert np.mean(hit(others)) <= 0.01


def test_language_kernel_by_brute_force():
    """Kernel values, landmarks, weights and scores of the batched products against sets and one dense solution."""
    import numpy as np
    import pyarrow as pa

    from radiograph.llm import language
    from radiograph.llm.common import text_bytes

    texts = ["The cat and the dog", "the dog ate", "ein Hund und eine Katze", "der Hund", "une chatte et un chien", "le chien", "THE END of it", "ab", "", "ü"] * 2
    names = ["en", "en", "de", "de", "fr", "fr", "en", "de", "fr", "de"] * 2

    def grams(text):
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        out = set()
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                code = 0
                for b in data[i : i + n]:
                    code = (code * 257 + b + 1) % 2**32
                out.add((code * int(language._FACTORS[n - 1]) % 2**32) >> 16)
        return out

    data, offsets = text_bytes(pa.array(texts))
    places, sizes = language.present(data, offsets)
    ends = np.cumsum(sizes)
    rows = [places[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    assert [set(x.tolist()) for x in rows] == [grams(t) for t in texts]
    model = language.trained(rows, names)
    marks = [i for known in ("de", "en", "fr") for i, n in enumerate(names) if n == known][: len(model.sizes)]
    kernel = np.array([[len(grams(a) & grams(texts[j])) / np.sqrt(max(len(grams(a)), 1) * max(len(grams(texts[j])), 1)) for j in marks] for a in texts])
    np.testing.assert_allclose(model.kernel(places, sizes), kernel, atol=1e-5)
    values, vectors = np.linalg.eigh(kernel[marks])
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    features, goal = kernel @ root, np.array([[1.0 if n == k else -1.0 for k in model.languages] for n in names])
    weight = np.array([len(names) / (names.count(n) * 3) for n in names])[:, None]
    wanted = features @ np.linalg.solve(features.T @ (features * weight) + language.RIDGE * len(names) * np.eye(root.shape[1]), features.T @ (goal * weight))
    np.testing.assert_allclose(model.scores(data, offsets), wanted, atol=0.02)
    assert [model.languages[k] for k in model.scores(data, offsets).argmax(1)][:8] == names[:8]
