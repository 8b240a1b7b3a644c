"""Operators against definitions that know nothing of their shortcuts."""

import collections
import hashlib
import itertools
import re
import string

import numpy as np
from pyspark.sql import functions as F

from radiograph.llm import decontamination, language, licenses, near_duplicates, packing, secrets, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def shared(w, v):
    """(n_places, doc_word, n_same, n_compared) by comparing at every place, or None."""
    found = []
    for shift in range(-len(v), len(w)):
        first, last = max(-shift, 0), min(len(v), len(w) - shift)
        same = [v[k] == w[k + shift] for k in range(first, last)]
        if len(v) < 10:
            hit = len(same) == len(v) and all(same)
        else:
            n = min(len(same), 13)
            hit = len(same) >= 10 and any(sum(same[k : k + n]) >= n - 2 for k in range(len(same) - n + 1))
        if hit:
            found.append((sum(same), -shift, first + shift, len(same)))
    return (len(found), max(found)[2], max(found)[0], max(found)[3]) if found else None


def test_decontamination_finds_every_change_of_two_words(spark):
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    items = {n: [word() for _ in range(n)] for n in range(1, 14)}
    texts = []
    for n in range(10, 14):
        for changed in itertools.chain(*(itertools.combinations(range(n), k) for k in range(4))):
            own = ["x" if k in changed else w for k, w in enumerate(items[n])]
            texts.append([word() for _ in range(int(r.integers(0, 4)))] + own + [word() for _ in range(int(r.integers(0, 4)))])
    for n in range(1, 10):
        texts += [items[n], [word(), *items[n], word(), *items[n]], items[n][:-1], [*items[n][:-1], "x"]]
    want = {(i, n): hit for i, w in enumerate(texts) for n, v in items.items() if (hit := shared(w, v))}
    bench = spark.createDataFrame([(n, " ".join(v)) for n, v in items.items()], "item_id long, text string")
    got = decontamination.contaminated(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), bench).collect()
    assert {(x["doc_id"], x["item_id"]): (x["n_places"], x["doc_word"], x["n_same"], x["n_compared"]) for x in got} == want


def test_licenses_finds_every_notice(spark):
    three = "Redistribution and use in source and binary forms, with or without modification, are permitted. This is free and unencumbered software released into the public domain. Released under the MIT License."
    every = ". ".join(notice for _, notice, _ in licenses.TEMPLATES)
    near = "filler words " * 30 + "this program is free software you MAY redistribute it and or modify it under the terms of the gnu general public license or licensed under cc by nc 4 0"
    texts = [(1, three), (2, every), (3, near), (4, "public license of mozilla"), *((i, "released under the mit license") for i in range(5, 40))]

    def shares(text):
        w = text.lower().replace(",", " ").replace(".", " ").split()
        for label, notice, key in licenses.TEMPLATES:
            of, need = notice.split(), key.split()
            at = next(k for k in range(len(of)) if of[k : k + len(need)] == need)
            for i in range(len(w)):
                if w[i : i + len(need)] == need:
                    yield label, sum(0 <= i - at + k < len(w) and w[i - at + k] == x for k, x in enumerate(of)) / len(of)

    for row in licenses.scan_licenses(documents(spark, texts)).collect():
        text = dict(texts)[row["doc_id"]]
        base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in " " + " ".join(text.lower().replace(",", " ").replace(".", " ").split()) + " "}
        assert set(filter(None, row["labels"].split(","))) == base | {label for label, share in shares(text) if share >= 0.75}
        assert row["score"] == (1.0 if base else max((share for _, share in shares(text)), default=0.0))
        assert row["doc_id"] != 1 or row["labels"] == "bsd,mit,unlicense"


def test_secrets_of_unknown_kinds_stay_secrets(spark):
    r = np.random.default_rng(4)
    key = lambda: "ghp_" + "".join(r.choice(list(string.ascii_letters + string.digits), 36))
    texts = [(i, f"plain words before {key()} and after") for i in range(1500)]
    found = secrets.find_secrets(documents(spark, texts)).where("exists(spans, s -> s.kind = 'cnn' and s.start = 19 and s.end = 59)").count()
    assert found >= 0.97 * len(texts)


def test_threshold_keeps_the_recall():
    findings = [(*f[:3], int(f[3] or i % 20 == 0)) for i, f in enumerate(secrets.labelled_table(1500))]
    network = secrets.trained(findings)
    held = [f for f in findings if f[3] and int(hashlib.md5("".join(f[:3]).encode()).hexdigest()[:8], 16) % 5 == 0]
    kept = [network.probability(np.stack([secrets.encoded(a + b + c, *w) for w in secrets.windows(len(a), len(a) + len(b))])).max() >= network.threshold for a, b, c, _ in held]
    assert np.mean(kept) >= secrets.RECALL and network.threshold < 0.5


def test_secrets_reads_whole_candidates(spark):
    r = np.random.default_rng(6)
    some = lambda k: "".join(r.choice(list(string.ascii_letters + string.digits), k))
    path = lambda: "/hooks/services/incoming/2024/" + "/".join(r.choice(["alerts", "billing", "reports", "archive", "users", "12"], 12))
    keys = [some(36) for _ in range(200)]
    texts = [(i, f"see {path()}/{k}{path()} there") for i, k in enumerate(keys)]
    texts += [(1000 + i, f"see {path()}{path()} there") for i in range(200)]
    texts += [(2000 + i, f"key {some(20)}G{'0123456789abcdef'}G{some(20)} end") for i in range(50)]
    got = {x["doc_id"]: x["text"] for x in secrets.without_secrets(documents(spark, texts)).collect()}
    assert sum(got[i] == "see [SECRET] there" for i in range(200)) >= 180
    assert sum(got[1000 + i] == dict(texts)[1000 + i] for i in range(200)) >= 190
    assert sum(got[2000 + i] == "key [SECRET] end" for i in range(50)) >= 48


def test_pipeline_decides_for_rows_without_an_id_and_repeated_rows(spark, tmp_path):
    import corpus_pipeline

    r = np.random.default_rng(7)
    text = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))
    item, one, two, three, four = text(30), text(60), text(60), text(60), text(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{text(9)} {item}"), (None, one), (None, one), (5, two), (5, two), (5, three), (None, four), (9, four), (8, f"{four} more"), (5, f"{item} {text(9)}")]
    rows = documents(spark, rows)
    single = corpus_pipeline.keep_one_of_each(spark, rows, str(tmp_path))
    assert sorted((str(x["doc_id"]), x["text"]) for x in single.collect() if item not in x["text"]) == sorted([("None", one), ("5", two), ("5", three), ("8", f"{four} more")])
    clean = corpus_pipeline.drop_benchmark_text(spark, rows, str(tmp_path))
    assert clean.count() == 8 and not any(item in x["text"] for x in clean.collect())


def test_packing_program_is_feasible_and_close_to_its_bound():
    r = np.random.default_rng(1)
    for counts in ({1000: 50, 900: 70, 150: 90}, dict(collections.Counter(np.clip(np.exp(r.normal(5.8, 1, 4000)).astype(int) + 1, 1, 2047).tolist()))):
        program = packing.linear_program(counts, 2048)
        held = collections.Counter()
        for config, amount in program.columns:
            assert amount > 0 and sum(x * n for x, n in config.items()) <= 2048
            for x, n in config.items():
                held[x] += n * amount
        assert all(held[x] >= n * (1 - 1e-6) for x, n in counts.items())
        assert packing.Knapsack(np.where(program.prices > 0, program.prices, -np.inf), 2048).best[-1] <= 1 + 1e-9
        assert abs(sum(program.prices[x] * n for x, n in counts.items()) - program.bound) < 1e-6 * program.bound
        assert program.gap < 0.03


def test_packing_comes_from_the_program():
    r = np.random.default_rng(0)
    for n in (600, 10_000):
        counts = dict(collections.Counter(np.clip(np.exp(r.normal(5.8, 1, n)).astype(int) + 1, 1, 2047).tolist()))
        made, from_program = packing.planned(counts, 2048)
        used = collections.Counter()
        for config, times in made:
            assert sum(x * k for x, k in config.items()) <= 2048 and times > 0
            for x, k in config.items():
                used[x] += k * times
        assert used == counts
        whole = sum(times for _, times in made)
        assert sum(times for _, times in made[:from_program]) >= 0.85 * whole and whole <= -(-sum(x * k for x, k in counts.items()) // 2048) + 1
    assert sum(times for _, times in packing.planned({1000: 50, 900: 70, 150: 90}, 2048)[0][:packing.planned({1000: 50, 900: 70, 150: 90}, 2048)[1]]) >= 60


def test_url_regression_on_held_out_names():
    names, rows, right = [*urls.UNWANTED, *urls.WANTED], urls.labelled_urls(), []
    for fold in range(4):
        held = set(names[fold::4])
        known = [r for r in rows if not held & set(r[0].split("."))]
        model = urls.fitted(known)
        right += [(urls.score_of(h, p, model) >= 0.5) == bool(y) for h, p, y in rows if held & set(h.split("."))]
    assert len(right) == len(rows) and np.mean(right) >= 0.8


def test_url_rules_by_brute_force(spark):
    r = np.random.default_rng(2)
    hosts = ["com", "example.com", "a.example.com", "notexample.com", "net", "example.net", "EXAMPLE.net", "x.org", "org", "xorg", ""]
    rows = [(i, f"{r.choice(['http', ''])}://{r.choice(hosts)}{r.choice(['', '/'])}{r.choice(['en/7', 'en/', 'de/8', 'de/', 'es/1', ''])}{r.choice(['', '?en/', '#x'])}") for i in range(600)]
    rows += [(None, "http://x.org/es/"), (5, "http://x.org/es/"), (700, ""), (701, "://"), (702, "http://" + "y" * 100_000 + "/en/")]
    got = collections.Counter((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"] if x["rule"] else None) for x in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    want = collections.Counter()
    for i, url in rows:
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path, host = re.match("[^?#]*", rest[len(host):])[0], host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[i, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None] += 1
    assert got == want
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_base_secrets_by_brute_force(spark):
    r = np.random.default_rng(9)
    bits = ["token", "API_KEY", "apikey", "PassWord", "passwd", "secret", '"', "'", " ", ": ", "=", " = ", "AKIA", "ABCDEFGHIJ0123", "0123456789abcdef", "dead", "x/+_.=-9", "é", "\n", "zq"]
    texts = [(i, "".join(r.choice(bits, int(r.integers(0, 30))))) for i in range(400)] + [(None, "token=abcdefghijkl"), (3, "token=abcdefghijkl"), (500, None), (501, "a" * 300_000 + " secret: " + "b" * 20)]
    value = set(string.ascii_letters + string.digits + "+/_.=-")

    def run(text, at, of):
        end = at
        while end < len(text) and text[end] in of:
            end += 1
        return end

    def base(text):
        found, low = [], "".join(c.lower() if c.isascii() else c for c in text)
        at = 0
        while at < len(text):  # names by priority, as in the pattern
            for name in ("password", "passwd", "secret", "token", "apikey", "api_key"):
                if not low.startswith(name, at):
                    continue
                p = at + len(name)
                p += text[p : p + 1] in ('"', "'") and p < len(text)
                p = run(text, p, " ")
                if text[p : p + 1] not in (":", "="):
                    continue
                p = run(text, p + 1, " ")
                p += text[p : p + 1] in ('"', "'") and p < len(text)
                if (end := run(text, p, value)) > p:
                    if end - p >= 12:
                        found.append((at, 0, f"assign:{at}:{end}"))
                    at = end - 1
                    break
            at += 1
        for kind, order, begin, of, least in (("access", 1, "AKIA", set(string.ascii_uppercase + string.digits), 18), ("hex", 2, "", set("0123456789abcdef"), 16)):
            at = 0
            while at < len(text):
                end = run(text, at + len(begin), of) if text.startswith(begin, at) else at
                if end > at + len(begin):
                    if end - at >= least:
                        found.append((at, order, f"{kind}:{at}:{end}"))
                    at = end
                else:
                    at += 1
        return [x for *_, x in sorted(found)]

    rows = secrets.digest(secrets.find_secrets(documents(spark, texts))).collect()
    got = collections.Counter((x["doc_id"], x["base_sha256"], x["n_assign"] + x["n_access"] + x["n_hex"]) for x in rows)
    want = collections.Counter()
    for i, text in texts:
        spans = base(text or "")
        want[i, hashlib.sha256(",".join(spans).encode()).hexdigest(), len(spans)] += 1
    assert got == want and sum(n for _, _, n in want) > 50
    assert secrets.find_secrets(documents(spark, [])).count() == 0


def test_near_duplicate_bounds_are_rare():
    from math import comb

    tail = lambda n, k, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
    assert tail(near_duplicates.SYMBOLS, 2 * near_duplicates.CHUNKS, 0.25) < 1e-5
    assert tail(near_duplicates.NIBBLES, near_duplicates.MOST_DIFFERENT + 1, 0.25 * 15 / 16) < 1e-9


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([x["lang"] == x["lang_pred"] for x in rows]) >= 0.98


def test_language_with_hard_rows(spark):
    kinds = {f"l{k:03}": chr(97 + k % 26) * 3 + chr(97 + k // 26) * 2 for k in range(300)}  # more languages than any bound of ours
    rows = [(10 * i + k, f"{text} {text}{i} " * 3, lang) for i, (lang, text) in enumerate(kinds.items()) for k in range(4)]
    rows += [(7, "dup dup", "l001")] * 50 + [(None, None, None), (None, "abc", "l002"), (99_999, "aaaaa " * 200_000, "l000"), (99_998, "", "l000")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows) and sum(x["lang_pred"] == lang for x, (_, _, lang) in zip(sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True)) > 0.9 * len(rows)
    nobody = language.identify(docs.where("false"))
    assert nobody.count() == 0
    assert {x["lang_pred"] for x in language.identify(docs.where("doc_id < 50").withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_with_hard_rows(spark, tmp_path):
    """Empty tables, nulls, empty and very long texts, repeated rows and extra columns go through every stage."""
    import corpus_pipeline

    r = np.random.default_rng(8)
    text = lambda n: " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))
    spark.createDataFrame([(None, None), (1, text(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, long = text(60), text(60_000)
    rows = [(1, one, "en", "s", 5, 9, "k"), (1, one, "en", "s", 5, 9, "k"), (None, text(50), "en", None, None, 9, "k"), (2, None, None, None, None, 9, "k"), (3, "", "en", "s", 0, 9, "k"), (4, long, "en", "s", len(long), 9, "k"), (5, "x" * 400_000, None, "s", 1, 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, key string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert stage.__doc__ and "ull" in stage.__doc__ and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    packed = collections.Counter(x["doc_id"] for x in docs.collect() if x["piece"] == 0)
    assert packed == {1: 1, None: 1, 4: 1, 5: 1}


def test_license_base_by_brute_force(spark):
    r = np.random.default_rng(13)
    bits = ["cc", "by", "CC", "all", "rights", "RESERVED", "general", "Public", "license", "gnu", "é", "x1"]
    texts = [(i, "".join(w + str(r.choice([" ", ", ", "-", "\n", ""], p=[0.6, 0.1, 0.1, 0.1, 0.1])) for w in r.choice(bits, int(r.integers(0, 25))))) for i in range(300)]
    texts += [(None, "CC by"), (4, "cc-by"), (400, None), (401, "general public license " * 20_000), (402, "x" * 500_000)]
    want = collections.Counter()
    for i, text in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        found = [(k, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
        want[i, len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({label for _, label in found}))] += 1
    rows = licenses.scan_licenses(documents(spark, texts)).collect()
    assert collections.Counter((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in rows) == want
    assert all(set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1 for x in rows)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0
