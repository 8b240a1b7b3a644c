"""The secret network learns from every matched window of every document, however many there are."""

import zlib

import numpy as np

from radiograph.llm import secrets


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def token(r, k):
    return "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), k)) + "7x"


def matched(text):
    """Encoded windows of candidates that a base match fills, or that hold all of one, by comparing each with each."""
    base = secrets.base_findings(text)
    held = [w for c in secrets.candidates(text) for w in secrets.windows(*c) if any(a <= w[0] and w[1] <= b or w[0] <= a and b <= w[1] for a, b, _ in base)]
    return {secrets.encoded(text, *w).astype(np.uint8).tobytes() for w in held}


def test_no_document_or_window_is_left_out(spark):
    r = np.random.default_rng(1)
    texts = [f"words {i} token={token(r, 20)} end" for i in range(4500)]
    texts += ["path/" + "".join(r.choice(list("0123456789abcdef"), 3000)) + "/token=" + token(r, 700) + "/AKIA" + "AB3" * 200, None, "", "plain words"]
    texts += texts[:300] + [f"x{token(r, int(r.integers(0, 60)))}/{r.integers(10**15, 10**18)}-secret={token(r, int(r.integers(4, 90)))}" for _ in range(300)]
    wanted = set().union(*(matched(t) for t in texts if t))
    found = [bytes(x["x"]) for x in secrets.document_windows(documents(spark, texts)).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(matched(texts[4500])) > 100


def test_lowest_kept_by_brute_force(spark):
    r = np.random.default_rng(2)
    for n, weight in ((1, 1.0), (700, 0.5), (3000, 0.25)):
        rows = [(float(v), bool(own)) for v, own in zip(np.round(r.normal(0, 5, n), 2) + (r.random(n) < 0.1) * 1e-9, r.random(n) < 0.7, strict=True)]
        goal, total, wanted = 0.01 * sum(weight if own else 1 for _, own in rows), 0.0, None
        for v, own in sorted(rows):
            total += weight if own else 1
            if total > goal:
                wanted = v
                break
        assert secrets.lowest_kept(spark.createDataFrame(rows, "logit double, own boolean"), weight, 0.99) == wanted


def test_scale_and_threshold_come_from_all_held_out_findings(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SHARD", 1000)
    r = np.random.default_rng(3)
    texts = [f"some words {i} api_key={token(r, int(r.integers(14, 40)))} and more" for i in range(4500)]
    made = secrets.labelled_table(1500)
    network = secrets.learned(documents(spark, texts), made)
    windows = sorted(set().union(*(matched(t) for t in texts)))
    own = network.logits(np.stack([np.frombuffer(w, np.uint8) for w in windows if zlib.crc32(w) % 5 == 0]))
    x, y, owner, held = secrets.labelled_windows(made)
    logit, y, owner = network.logits(x[held]), y[held], owner[held]
    weight = min(1.0, y.sum() / len(own))
    assert len(own) > 800 and weight < 0.5

    both, ones = np.append(logit, own), np.append(np.ones(len(logit)), np.full(len(own), weight))
    told = np.append(y, np.ones(len(own)))
    n_secrets, n_plain = (ones * told).sum(), (ones * (1 - told)).sum()
    goal = np.where(told > 0, (n_secrets + 1) / (n_secrets + 2), 1 / (n_plain + 2))
    d = ones * (1 / (1 + np.exp(-(network.scale * both + network.shift))) - goal)
    assert abs((d * both).sum()) < 0.05 and abs(d.sum()) < 0.05

    best = [logit[owner == i].max() for i in np.unique(owner[y > 0])]
    values, counts = np.append(best, own), np.append(np.ones(len(best)), np.full(len(own), weight))
    order = np.argsort(values)
    least = values[order][np.argmax(np.cumsum(counts[order]) > (1 - secrets.RECALL) * counts.sum())]
    assert abs(network.threshold + 1e-9 - 1 / (1 + np.exp(-(network.scale * least + network.shift)))) < 1e-12


def test_shards_are_averaged_alike_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(secrets, "SHARD", 100)
    r = np.random.default_rng(4)
    texts = [f"a key {i} passwd={token(r, 24)} there" for i in range(400)]
    made = secrets.labelled_table(600)
    one, other = (secrets.learned(docs, made) for docs in (documents(spark, texts).repartition(7), documents(spark, texts[::-1] * 2).coalesce(1)))
    assert np.array_equal(one.state(), other.state()) and one.threshold == other.threshold
    without = secrets.learned(documents(spark, texts[:-1]), made)
    assert not np.array_equal(one.state(), without.state()) or one.threshold != without.threshold
