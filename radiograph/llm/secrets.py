"""Secrets in documents: pattern findings, and a character convolutional network over every other candidate.

Base findings are matches of three patterns. Every further run of 16 or more key characters with a letter and a digit
is a candidate, unless base matches cover all of it; a small one-dimensional convolutional network in numpy reads it with
24 characters of context on either side. Runs of more than 48 characters are read in overlapping windows, and the whole
run is a finding if any window is. It is trained on labelled findings: seeded tables of generated keys, look-alikes and long paths with and without a key, and
every window of every document that a base pattern matches, copies once. Those that none matches may be secrets of other
kinds and stay unlabelled. Training goes in rounds over shards of the windows, each with all generated findings, whose
weights are averaged. Logits are calibrated by Platt scaling on all held-out findings, and the threshold is the highest
that still keeps `RECALL` of the held-out secrets; there those of documents weigh at most as much as generated ones.

Null and empty texts have no findings. Rows are judged one by one, so repeated rows repeat their result, and null ids
keep theirs; extra columns are ignored (a column named spans is replaced); an empty table gives no rows. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "cnn")
CONTEXT, INNER = 24, 48
#: Places from one window of a long run to the next.
STEP = 12
WIDTH = 2 * CONTEXT + INNER
RECALL = 0.99
#: Rounds of training, about so many windows of documents in a shard of it, and the unit of the weights that are averaged.
ROUNDS, SHARD, UNIT = 8, 8_192, 2.0**40
#: Windows that are handed on, or read by the network, at once.
WINDOWS_AT_ONCE = 512


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters with a letter and a digit."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            out.append(m.span())
    return out


_CLASSES = {c: i + 1 for i, c in enumerate(string.ascii_letters + string.digits + string.punctuation + " \n")}


def windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The stretches of INNER characters in which a candidate is read: one if it is no longer."""
    for at in range(start, end - INNER, STEP):
        yield at, at + INNER
    yield max(start, end - INNER), end


def covered(start: int, end: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether the base matches, sorted by start, cover every character."""
    for a, b, _ in base:
        if a <= start < b:
            start = b
    return start >= end


def matched_windows(text: str) -> Iterator[tuple[int, int]]:
    """The windows of candidates that a base match fills, or that hold all of one."""
    places: dict[str, tuple[list[int], list[int]]] = {}
    for a, b, kind in base_findings(text):
        starts, ends = places.setdefault(kind, ([], []))
        starts.append(a)
        ends.append(b)

    def matched(starts: list[int], ends: list[int], a: int, b: int) -> bool:
        # Matches of a kind don't overlap: only the last that begins by a can fill the window, and the first from a on ends first.
        last, first = bisect_right(starts, a) - 1, bisect_left(starts, a)
        return last >= 0 and b <= ends[last] or first < len(starts) and ends[first] <= b

    for c in candidates(text) if places else ():
        yield from (w for w in windows(*c) if any(matched(*of, *w) for of in places.values()))


def encoded(text: str, start: int, end: int) -> np.ndarray:
    """Character classes of a window and its context; of a longer stretch, its first INNER characters are the window."""
    end = min(end, start + INNER)
    run = text[start:end]
    window = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0") + run.ljust(INNER, "\0") + text[end : end + CONTEXT].ljust(CONTEXT, "\0")
    return np.array([_CLASSES.get(c, 0 if c == "\0" else len(_CLASSES) + 1) for c in window], np.int16)


class CharacterNetwork:
    """Embedding, one convolution with rectifier, maximum and mean over places, one dense layer; Adam on the log loss."""

    def __init__(self, seed: int = 5, dim: int = 8, width: int = 5, filters: int = 24):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "emb": r.normal(0, 0.5, (len(_CLASSES) + 2, dim)), "w": r.normal(0, (2 / (dim * width)) ** 0.5, (dim * width, filters)), "b": np.zeros(filters),
            "v": r.normal(0, 0.2, 4 * filters), "c": np.zeros(1),
        }
        self.m, self.v, self.steps = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0.0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[0]

    def state(self) -> np.ndarray:
        """Weights, Adam's means (roots of those of squares) and its number of steps as one vector."""
        roots = {k: np.sqrt(a) for k, a in self.v.items()}
        return np.concatenate([a.ravel() for of in (self.p, self.m, roots) for a in of.values()] + [[self.steps]])

    def resume(self, state: np.ndarray) -> None:
        at = 0
        for of in (self.p, self.m, self.v):
            for k, a in of.items():
                of[k] = state[at : at + a.size].reshape(a.shape).copy()
                at += a.size
        self.v = {k: a * a for k, a in self.v.items()}
        self.steps = float(state[at])

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["emb"][x]
        n, t, d = e.shape
        cols = np.concatenate([e[:, k : t - self.width + 1 + k] for k in range(self.width)], 2)
        z = cols @ self.p["w"] + self.p["b"]
        h = np.maximum(z, 0)
        inner = slice(CONTEXT - self.width + 1, CONTEXT + INNER)
        outer = np.r_[0 : CONTEXT - self.width + 1, CONTEXT + INNER : h.shape[1]]
        hi, ho = h[:, inner], h[:, outer]
        f = np.concatenate([hi.max(1), hi.mean(1), ho.max(1), ho.mean(1)], 1)
        return f @ self.p["v"] + self.p["c"][0], (x, cols, z, h, inner, outer, hi, ho, f)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = ROUNDS, size: int = 64, rate: float = 0.004, seed: int | list[int] = 6, weight: np.ndarray | None = None) -> None:
        r, m, v = np.random.default_rng(seed), self.m, self.v
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), size):
                at = order[lo : lo + size]
                logit, cache = self._forward(x[at])
                d = (1 / (1 + np.exp(-logit)) - y[at]) / len(at)
                self.steps += 1
                for k, g in self._gradients(d if weight is None else d * weight[at], cache).items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**self.steps)) / (np.sqrt(v[k] / (1 - 0.999**self.steps)) + 1e-8)

    def _gradients(self, d: np.ndarray, cache: tuple) -> dict[str, np.ndarray]:
        x, cols, z, h, inner, outer, hi, ho, f = cache
        n, q = len(x), self.p["b"].size
        df = d[:, None] * self.p["v"]
        dh, rows = np.zeros_like(h), np.arange(n)[:, None]
        for part, places, part_of in ((0, np.arange(h.shape[1])[inner], hi), (2, outer, ho)):
            dh[:, places] += df[:, None, (part + 1) * q : (part + 2) * q] / len(places)
            dh[rows, places[part_of.argmax(1)], np.arange(q)] += df[:, part * q : (part + 1) * q]
        dz = dh * (z > 0)
        dcols = dz @ self.p["w"].T
        dim, t = self.p["emb"].shape[1], cols.shape[1]
        de = np.zeros((n, x.shape[1], dim))
        for k in range(self.width):
            de[:, k : k + t] += dcols[:, :, k * dim : (k + 1) * dim]
        demb = np.zeros_like(self.p["emb"])
        np.add.at(demb, x.ravel(), de.reshape(-1, dim))
        return {"emb": demb, "w": np.tensordot(cols, dz, ([0, 1], [0, 1])), "b": dz.sum((0, 1)), "v": f.T @ d, "c": np.array([d.sum()])}

    def calibrate(self, x: np.ndarray, y: np.ndarray, owner: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling by gradient descent, then the highest threshold that keeps the recall of findings (owner), by their best window."""
        logit, a, b = self._forward(x)[0], 1.0, 0.0
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(500):
            d = 1 / (1 + np.exp(-(a * logit + b))) - goal
            a, b = a - 0.05 * (d * logit).mean(), b - 0.05 * d.mean()
        self.scale, self.shift = a, b
        best = np.zeros(owner.max() + 1 if len(owner) else 0)
        np.maximum.at(best, owner, self.probability(x))
        wanted = np.sort(best[np.unique(owner[y > 0])])
        # Less by more than rounding differs between batches, so that the finding at the threshold itself passes in any.
        self.threshold = float(wanted[int((1 - recall) * len(wanted))]) - 1e-9 if len(wanted) else 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self._forward(x)[0] + self.shift))) if len(x) else np.zeros(0)


def numbers_and_codes(r: np.random.Generator) -> list:
    """Makers of runs that are as long as keys and hold digits, but name books, parts, orders, pictures, calls and places."""
    def digits(k: int) -> str:
        return "".join(str(x) for x in r.integers(0, 10, k))

    def capitals(k: int) -> str:
        return "".join(chr(65 + x) for x in r.integers(0, 26, k))

    def groups(*lengths: int, by: str = "-") -> str:
        return by.join(digits(k) for k in lengths)

    return [
        lambda: "ISBN" + str(r.choice(["", "-13-", "-", "_"])) + groups(3, 1, int(r.integers(2, 6)), int(r.integers(2, 6)), 1), lambda: "ISBN" + groups(3, 3, int(r.integers(2, 5)), int(r.integers(1, 4))),
        lambda: "+" + groups(2, 3, int(r.integers(3, 5)), 4), lambda: capitals(int(r.integers(2, 5))) + "-" + groups(4, int(r.integers(5, 9))), lambda: capitals(2) + groups(2, 4, 4, by=str(r.choice(["-", "_", "/"]))) + capitals(1),
        lambda: str(r.choice(["IMG", "DSC", "SCAN", "VID"])) + "_" + groups(8, 6, by="_"), lambda: "10." + digits(4) + "/" + groups(4, 4, int(r.integers(2, 6)), by=str(r.choice([".", "-"]))), lambda: groups(4, 4, 4, int(r.integers(4, 8)), by=str(r.choice(["-", "_", "."]))),
        lambda: str(r.choice(["order", "invoice", "ticket", "article", "model", "part"])) + "-" + groups(4, int(r.integers(6, 10))), lambda: digits(int(r.integers(16, 24))),
    ]


def labelled_table(n: int = 5_000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(left, run, right, is a secret) of generated findings: keys of common kinds, and runs that only look like keys."""
    r = np.random.default_rng(seed)
    letters, digits, hexes = string.ascii_letters, string.digits, "0123456789abcdef"

    def some(of: str, k: int) -> str:
        return "".join(of[i] for i in r.integers(0, len(of), k))

    def words(k: int) -> list[str]:
        return ["".join(r.choice(["an", "ti", "re", "lo", "ment", "der", "que", "in", "os", "sta", "ver", "la"], r.integers(1, 4))) for _ in range(k)]

    secret = [
        lambda: "ghp_" + some(letters + digits, 36), lambda: "sk-" + some(letters + digits, int(r.integers(24, 49))), lambda: "xoxb-" + some(digits, 12) + "-" + some(letters + digits, 24),
        lambda: some(letters + digits + "+/", int(r.integers(24, 64))) + "=" * int(r.integers(0, 3)), lambda: "AIza" + some(letters + digits + "_-", 35), lambda: "eyJ" + some(letters + digits + "_-", 40),
        lambda: some(hexes.upper(), int(r.integers(32, 65))), lambda: some(letters + digits, int(r.integers(20, 41))),
    ]
    plain = [
        lambda: "-".join(words(4)) + "-" + some(digits, int(r.integers(1, 5))), lambda: "_".join(words(4)) + some(digits, int(r.integers(1, 3))), lambda: "/" + "/".join(words(3)) + "/" + some(digits, int(r.integers(2, 8))),
        lambda: f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(0, 24):02d}-{r.integers(0, 60):02d}-00Z", lambda: "".join(w.title() for w in words(5)) + some(digits, 1),
        lambda: some("ab", 1) * int(r.integers(12, 30)) + some(digits, 4) * 2, lambda: "version-" + "-".join(str(x) for x in r.integers(0, 99, 4)) + "-" + words(1)[0], lambda: "=" * 14 + words(1)[0] + some(digits, 2) + "=" * 14,
    ]
    plain += numbers_and_codes(r)
    rows = []
    for i in range(n):
        is_secret = i % 2
        kinds = secret if is_secret else plain
        maker = kinds[int(r.integers(0, len(kinds)))]
        run = maker()
        left = " ".join(words(4)) + (str(r.choice([" ", ' key: "', " auth=", " bearer ", "\n"])) if is_secret else str(r.choice([" ", "\n", " (", " at "])))
        rows.append((left, run, str(r.choice([" ", '" ', ". ", "\n"])) + " ".join(words(4)), is_secret))
    return rows


def path_table(n: int = 1_500, seed: int = 12) -> list[tuple[str, str, str, int]]:
    """(left, window, right, holds a secret) of windows of long paths and joined names, every second one around a key."""
    r = np.random.default_rng(seed)
    syllables = ["an", "ti", "re", "lo", "ment", "der", "que", "in", "os", "sta", "ver", "la", "hook", "serv", "arch", "ive"]

    def pieces(k: int, by: str) -> str:
        return by.join("".join(r.choice(syllables, r.integers(1, 4))) if r.random() < 0.8 else str(r.integers(0, 10 ** int(r.integers(1, 9)))) for _ in range(k))

    rows = []
    for i in range(n):
        is_secret, by = i % 2, str(r.choice(["/", "/", "_", "-"]))
        before, after = (by + pieces(int(r.integers(12, 20)), by) + by for _ in range(2))
        of = "0123456789ABCDEF" if i % 8 == 1 else string.ascii_letters + string.digits
        key = "".join(of[k] for k in r.integers(0, len(of), r.integers(20, 41))) if is_secret else pieces(3, by)
        run = before + key + after
        at = len(before) + len(key) - INNER + int(r.integers(0, INNER - len(key) + 1)) if is_secret else int(r.integers(0, len(run) - INNER))
        rows.append((run[max(0, at - CONTEXT) : at], run[at : at + INNER], run[at + INNER : at + INNER + CONTEXT], is_secret))
    return rows


def labelled_windows(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encoded windows of the findings, their labels, their findings' numbers, and whether these are held out: every fifth."""
    parts = [(i, left + run + right, w) for i, (left, run, right, _) in enumerate(findings) for w in windows(len(left), len(left) + len(run))]
    x, owner = np.stack([encoded(text, *w) for _, text, w in parts]), np.array([i for i, *_ in parts])
    y = np.array([label for *_, label in findings], float)[owner]
    held = np.array([int(hashlib.md5("".join(f[:3]).encode()).hexdigest()[:8], 16) % 5 == 0 for f in findings])[owner]
    return x, y, owner, held


def trained(findings: list[tuple[str, str, str, int]]) -> CharacterNetwork:
    """A calibrated network; every fifth finding is held out for calibration."""
    x, y, owner, held = labelled_windows(findings)
    network = CharacterNetwork()
    network.train(x[~held], y[~held])
    network.calibrate(x[held], y[held], owner[held])
    return network


def document_windows(documents: DataFrame) -> DataFrame:
    """x, the character classes of every matched window of every document, without copies; written."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (encoded(t, *w).astype(np.uint8).tobytes() for t in batch.column(0).to_pylist() if t for w in matched_windows(t))
            while part := list(islice(found, WINDOWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["x"])

    return written(documents.select(F.col("text").cast("string")).mapInArrow(read, "x binary").distinct(), "windows")


def _decoded(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _train_on_shards(network: CharacterNetwork, x: np.ndarray, y: np.ndarray, own: DataFrame) -> None:
    """ROUNDS epochs over the generated windows and own(x), secrets all: in each, shards train apart and are averaged.

    Every window of own is in one shard; where a shard has more than there are generated secrets, they weigh as much as these.
    """
    spark = own.sparkSession
    shards = max(1, -(-own.count() // SHARD))
    rows = own.select(F.pmod(F.xxhash64("x"), F.lit(shards)).alias("shard"), "x").union(spark.range(shards).select("id", F.lit(None).cast("binary")))
    rows = rows.repartition(shards, "shard")
    made = spark.sparkContext.broadcast((x.astype(np.uint8), y))

    def epoch(start: np.ndarray, number: int):
        def one(key: tuple, table: pa.Table) -> pa.Table:
            (x, y), shard = made.value, key[0].as_py()
            theirs = _decoded(table.column("x").drop_null().sort())
            weight = np.append(np.ones(len(x)), np.full(len(theirs), min(1.0, y.sum() / max(1, len(theirs)))))
            copy = CharacterNetwork()
            copy.resume(start)
            copy.train(np.concatenate([x, theirs]), np.append(y, np.ones(len(theirs))), epochs=1, seed=[6, number, shard], weight=weight)
            state = np.rint(copy.state() * UNIT).astype(np.int64)  # whole numbers add up alike in any order
            return pa.table({"place": pa.array(np.arange(len(state)), pa.int32()), "total": pa.array(state)})

        return one

    for number in range(ROUNDS):
        totals = rows.groupBy("shard").applyInArrow(epoch(network.state(), number), "place int, total long").groupBy("place").agg(F.sum("total").alias("total")).toArrow().sort_by("place")
        network.resume(totals.column("total").to_numpy() / UNIT / shards)
    made.unpersist()


def _platt_sums(logit: np.ndarray, goal: np.ndarray | float, scale: float, shift: float) -> list[float]:
    """Log loss, its gradient and the upper half of its second derivatives in scale and shift."""
    z = scale * logit + shift
    p = 1 / (1 + np.exp(-z))
    d, q = p - goal, p * (1 - p)
    return [float(a.sum()) for a in (np.maximum(z, 0) + np.log1p(np.exp(-abs(z))) - goal * z, d * logit, d, q * logit * logit, q * logit, q)]


def _scale_by_all(network: CharacterNetwork, logit: np.ndarray, y: np.ndarray, own: DataFrame, n: int, weight: float) -> None:
    """Platt scaling by Newton's method over generated held-out windows and own(logit), n secrets that count `weight` each."""
    secrets = y.sum() + n * weight
    goal = (secrets + 1) / (secrets + 2)
    goals = np.where(y > 0, goal, 1 / (len(y) - y.sum() + 2))

    def sums(at: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([s]) for s in _platt_sums(batch.column(0).to_numpy(), goal, *at)], names=list("abcdef"))

        theirs = own.mapInArrow(part, ", ".join(f"{c} double" for c in "abcdef")).agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in "abcdef")).first()
        return np.array(_platt_sums(logit, goals, *at)) + weight * np.array(theirs)

    at, step = np.array([network.scale, network.shift]), np.zeros(2)
    now = sums(at)
    for _ in range(20):
        step = -np.linalg.solve(np.array([[now[3], now[4]], [now[4], now[5]]]) + 1e-9 * np.eye(2), now[1:3])
        while (new := sums(at + step))[0] > now[0] and abs(step).max() > 1e-4:
            step = step / 4
        if new[0] > now[0]:
            break
        at, now = at + step, new
        if abs(step).max() <= 1e-3:
            break
    network.scale, network.shift = float(at[0]), float(at[1])


def lowest_kept(values: DataFrame, weight: float, recall: float = RECALL) -> float:
    """The highest logit at or above which `recall` of values(logit, own) lies, exactly; a row with own counts `weight`, others one.

    The range that holds it is divided into buckets, whose numbers of rows tell in which of them to go on.
    """
    counts = (F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_made"), F.min("logit").alias("lo"), F.max("logit").alias("hi"))
    held = values.agg(*counts).first()
    lo, hi, below, goal = held["lo"], held["hi"], 0.0, (1 - recall) * (held["n_own"] * weight + held["n_made"])
    while lo < hi:
        inside = values.where(F.col("logit").between(lo, hi))
        buckets = inside.groupBy(F.floor((F.col("logit") - lo) / (hi - lo) * 1024).alias("bucket")).agg(*counts).orderBy("bucket").collect()
        for row in buckets:
            lo, hi, own = row["lo"], row["hi"], row["n_own"] * weight + row["n_made"]
            if below + own > goal:
                break
            below += own
        else:
            return hi
    return lo


def learned(documents: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> CharacterNetwork:
    """The network trained and calibrated on generated findings and on every matched window of documents(text)."""
    spark = documents.sparkSession
    x, y, owner, held = labelled_windows(findings or labelled_table() + path_table())
    found = document_windows(documents)
    out = F.crc32("x") % 5 == 0
    network = CharacterNetwork()
    _train_on_shards(network, x[~held], y[~held], found.where(~out))
    network.calibrate(x[held], y[held], owner[held])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, WINDOWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(network.logits(_decoded(batch.column(0).slice(lo, WINDOWS_AT_ONCE))))], names=["logit"])

    tasks = max(1, -(-found.count() // SHARD))
    logits = written(found.where(out).repartition(tasks, "x").mapInArrow(read, "logit double"), "logits")
    n, made = logits.count(), network.logits(x[held])
    if n:
        weight = min(1.0, y[held].sum() / n)
        _scale_by_all(network, made, y[held], logits, n, weight)
        best = np.full(owner.max() + 1, -np.inf)
        np.maximum.at(best, owner[held], made)
        kept = spark.createDataFrame([(float(b), False) for b in best[np.unique(owner[held & (y > 0)])]], "logit double, own boolean")
        least = lowest_kept(logits.withColumn("own", F.lit(True)).union(kept), weight)
        network.threshold = float(1 / (1 + np.exp(-(network.scale * least + network.shift)))) - 1e-9
    return network


def all_findings(texts: list[str], network: CharacterNetwork) -> list[list[tuple[int, int, str]]]:
    """Base findings and, of the candidates that they don't cover wholly, those that the network takes for secrets."""
    out = [base_findings(text) for text in texts]
    passed: dict[tuple[int, int, int], None] = {}
    open_ones = ((i, a, b) for i, text in enumerate(texts) for a, b in candidates(text) if not covered(a, b, out[i]))
    parts = ((c, w) for c in open_ones for w in windows(c[1], c[2]))
    while part := list(islice(parts, WINDOWS_AT_ONCE)):
        probabilities = network.probability(np.stack([encoded(texts[c[0]], *w) for c, w in part]))
        passed |= dict.fromkeys(c for (c, _), p in zip(part, probabilities, strict=True) if p >= network.threshold)
    for i, a, b in passed:
        out[i] = [*out[i], (a, b, "cnn")]
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_SPAN_FIELD = T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])))


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by one mask."""
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], mask]
        elif parts and end > at:
            pass
        at = max(at, end)
    return "".join([*parts, text[at:]]) if spans else text


def _scanned(documents: DataFrame, mask: bool) -> DataFrame:
    """documents(doc_id, text, ...) with a column spans; with mask, text has its secrets masked."""
    small_batches(documents.sparkSession)
    documents = documents.drop("spans")
    network = learned(documents)
    place = documents.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                values, columns = part.column(place).to_pylist(), list(part.columns)
                found = all_findings([v or "" for v in values], network)
                if mask:
                    columns[place] = pa.array([v if v is None else masked(v, f) for v, f in zip(values, found, strict=True)], part.schema.field(place).type)
                spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found], _SPAN)
                yield pa.RecordBatch.from_arrays([*columns, spans], names=[*part.schema.names, "spans"])

    return documents.mapInArrow(scan, T.StructType([*documents.schema.fields, _SPAN_FIELD]))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and the spans of each row of documents(doc_id, text)."""
    return _scanned(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), False).select("doc_id", "spans")


def without_secrets(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, n_chars, ...) with every secret masked, and n_chars counted anew where the text changed."""
    out = _scanned(documents, True)
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed.cast(documents.schema["n_chars"].dataType)).drop("spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts, base digest and the joined spans of find_secrets()."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
