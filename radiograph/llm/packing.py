"""Best-fit packing of tokenised documents into sequences of a fixed length.

Lengths are first counted: the histogram has at most `capacity` entries whatever the input holds, so the packing is
planned on the driver. The configuration linear program over it (cover every length as often as it occurs, by as few
configurations as it takes) is solved by multiplicative weights: in each round a knapsack dynamic program prices the
lengths' configurations under the current weights, nearly best ones are bought, and the weights of the lengths that lag
behind rise. The same program scales the prices to a dual solution, which bounds the optimum. The cover is rounded to
whole configurations; what rounding leaves is bought from the residual program in whole numbers, and the last few
per cent are packed best fit, longest first, on the histogram as well. Pieces then find their place by their rank among
the pieces of their length: ranks come from counts of salted groups, so that one very common length is never gathered.

A null or empty text is a document of one token (id 0). Repeated rows are packed as often as they occur; a null doc_id
stays null. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_batches, written

CAPACITY = 2048
#: Words met again whose ids a task remembers; when it has so many, it begins anew and keeps these as the older ones.
CACHED_WORDS = 100_000
#: Bytes that tell, by hash, which words a task has met: most words of a large corpus stand in it once and aren't kept.
MET_PLACES = 1 << 20
#: How far below the best value each step and the whole of a bought configuration may be, and configurations tried before the knapsack is solved anew.
TOLERANCE, CLOSE, COLUMNS = 2e-3, 1e-2, 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Whole-text ids of a word-level BPE tokenizer, remembered by word.

    The tokenizer drops white space, so a text's ids are those of its words one after the other; the test suite holds
    that against encoding whole texts. Texts with separators that Python and the tokenizer see differently are encoded
    whole. Texts of Latin letters are lower-cased as a whole, as the tokenizer does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.met = bytearray(MET_PLACES)
        self.byte_letters = _byte_letters()

    def _encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        """One pre-token: letters only, or marks only, in lower case."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.byte_letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """A lower-case word of Latin letters and other characters below U+0250."""
        if word.isalpha():
            return self._part(word)
        core = word.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
        rest = word[len(core):]
        if core.isalpha() and "<|" not in rest:
            return self._remembered(core) + self._remembered(rest)
        return self._encoded(word)

    def _remembered(self, part: str) -> bytes:
        return self.known.get(part) or self.older.get(part) or self._part(part)

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if _SEPARATORS.search(text) or ("<|" in text and "|>" in text):
            return self._encoded(text)
        if text.isascii() or (max(text) < "ɐ" and "İ" not in text):
            words, lowered = text.lower().split(), True
        else:
            words, lowered = text.split(), False
        return b"".join(self._looked_up(words[i : i + CACHED_WORDS], lowered) for i in range(0, len(words), CACHED_WORDS))

    def _looked_up(self, words: list[str], lowered: bool) -> bytes:
        known, older, met, tokenize = self.known, self.older, self.met, self.tokenizer.model.tokenize
        once: dict[str, bytes] = {}
        for word in set(words).difference(known):
            ids = older.get(word)
            if ids is None:
                if not lowered:
                    ids = self._encoded(word)
                elif word.isascii() and word.isalpha():
                    ids = array("I", [t.id for t in tokenize(word)]).tobytes()
                else:
                    ids = self._word(word)
                place = hash(word) % MET_PLACES
                if not met[place]:
                    met[place] = 1
                    once[word] = ids
                    continue
            known[word] = ids
        found = b"".join([once[w] if w in once else known[w] for w in words] if once else map(known.__getitem__, words))
        if len(known) > CACHED_WORDS:
            self.known, self.older, self.met = {}, known, bytearray(MET_PLACES)
        return found


#: Characters that separate words for Python alone or for the tokenizer alone.
_SEPARATORS = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE shows each byte as: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(free)}


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids, then id 0, cut into pieces of at most `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer(path)  # for this task only: a worker that lives on keeps no words
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.ids(text.as_py() or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


class Knapsack:
    """The unbounded knapsack over lengths 1 to capacity, by dynamic programming: the pricing problem of the program."""

    def __init__(self, values: np.ndarray, capacity: int):
        """values[l] is the price of length l, minus infinity where it may not be used; values[0] is not read."""
        best, exact, last = np.zeros(capacity + 1), np.zeros(capacity + 1, bool), np.zeros(capacity + 1, np.int64)
        self.values, self.best, self.exact, self.last = values, best, exact, last
        usable, exact[0] = np.flatnonzero(np.isfinite(values[1:])) + 1, True
        self.longest = int(usable[-1]) if len(usable) else 0
        down = values[self.longest : 0 : -1].copy()
        for c in range(int(usable[0]) if len(usable) else capacity + 1, capacity + 1):
            w = min(c, self.longest)
            gain = best[c - w : c] + down[self.longest - w :]
            most = gain.max()
            if most > best[c - 1]:
                best[c], last[c] = most, c  # last: where the next length is taken
            else:
                best[c], last[c] = best[c - 1], last[c - 1]
            exact[c] = ((gain >= best[c] - TOLERANCE) & exact[c - w : c]).any()  # nearly the best without any room left

    def column(self, need: np.ndarray, chance: np.ndarray, whole: bool) -> dict[int, int]:
        """A configuration of lengths still needed whose every step is nearly the best, if it can be one that leaves no room.

        With `whole`, it holds no length more often than it is needed, and prefers long ones: short ones fill up the rest.
        """
        out: dict[int, int] = {}
        wanted, c = need * chance, len(self.best) - 1
        if whole:
            wanted *= (np.arange(c + 1) / c) ** 4
        while c > 0 and self.longest:
            w = min(c, self.longest)
            good = self.best[c - w : c][::-1] + self.values[1 : w + 1] >= self.best[c] - TOLERANCE
            if self.exact[c]:
                good &= self.exact[c - w : c][::-1]
            size = int(np.where(good, wanted[1 : w + 1], 0.0).argmax()) + 1
            if not wanted[size] or not good[size - 1]:
                if self.last[c] == c:
                    break
                c = int(self.last[c])
                continue
            out[size] = out.get(size, 0) + 1
            c -= size
            if whole and out[size] + 1 > need[size]:
                wanted[size] = 0.0
        return out

    def worth(self, config: dict[int, int]) -> float:
        return sum(self.values[x] * n for x, n in config.items())


class Program:
    """A configuration linear program's solution: columns (configuration, amount), dual prices and their lower bound."""

    def __init__(self, columns: list[tuple[dict[int, int], float]], prices: np.ndarray, bound: float):
        self.columns, self.prices, self.bound = columns, prices, bound

    @property
    def value(self) -> float:
        return sum(amount for _, amount in self.columns)

    def room(self, capacity: int) -> float:
        """What the columns leave unused."""
        return sum(amount * (capacity - sum(x * n for x, n in config.items())) for config, amount in self.columns)

    @property
    def gap(self) -> float:
        """By how much the cover may be larger than the best one, at most."""
        return self.value / self.bound - 1 if self.bound else 0.0


def linear_program(counts: dict[int, int], capacity: int, rounds: int | None = None, rate: float = 4.0, whole: bool = False, seed: int = 9) -> Program:
    """Cover every length as often as it occurs by as few configurations as it takes, by multiplicative weights.

    Each round prices the lengths (by their size, times exp of how far their cover lags behind), solves the knapsack
    under these prices, and buys configurations of nearly the best value until the cover has this round's share of all
    tokens. The knapsack's value scales the prices to a feasible dual solution, which bounds the optimum; rounds end
    once the cover is that close to the bound. What then is left is covered by a last purchase, so that the cover is
    feasible. With `whole`, only whole numbers are bought, and the last purchase is left out.
    """
    demand = np.zeros(capacity + 1)
    for length, n in counts.items():
        demand[length] = n
    used = np.flatnonzero(demand)
    if not len(used):
        return Program([], np.zeros(capacity + 1), 0.0)
    rounds = rounds or max(6, min(48, 2 * capacity // len(used)))
    size = np.arange(capacity + 1) / capacity
    r, cover, columns = np.random.default_rng(seed), np.zeros(capacity + 1), []
    prices, bound, tokens, held = np.zeros(capacity + 1), 0.0, float(demand @ size), 0.0

    def buy(config: dict[int, int], amount: float, *needs: np.ndarray) -> None:
        columns.append((config, amount))
        for x, n in config.items():
            cover[x] += n * amount
            for need in needs:
                need[x] -= n * amount
                if need[x] < 1e-9 * demand[x]:
                    need[x] = 0.0

    for turn in range(1, rounds + 1):
        share, misses = turn / rounds, 0
        values = np.full(capacity + 1, -np.inf)
        values[used] = size[used] * np.exp(rate * np.clip(share - cover[used] / demand[used], -1, 1))
        knapsack = Knapsack(values, capacity)
        if (worth := float(demand[used] @ values[used]) / knapsack.best[-1]) > bound:
            prices, bound = np.where(np.isfinite(values), values, 0.0) / knapsack.best[-1], worth
        # A length may run one share ahead, so that there is always something to fill up with.
        need = np.clip(min(1.0, share + 1 / rounds) * demand - cover, 0.0, None)
        if whole:
            need = np.minimum(np.ceil(need), demand - cover)
        while held < share * tokens and need.any() and misses < 3:
            before = len(columns)
            for _ in range(COLUMNS):
                config = knapsack.column(need, r.random(capacity + 1), whole)
                amount = min((need[x] / n for x, n in config.items()), default=0.0)
                if whole:
                    amount = float(int(amount))
                if amount <= 0 or knapsack.worth(config) < (1 - CLOSE) * knapsack.best[-1]:
                    continue
                buy(config, amount, need)
                held += amount * sum(size[x] * n for x, n in config.items())
                if held >= share * tokens:
                    break
            misses += len(columns) - before < COLUMNS // 8
            if held < share * tokens and need.any():
                knapsack = Knapsack(np.where(need > 0, values, -np.inf), capacity)  # of what this round still asks for
        if held >= tokens * (1 - CLOSE):
            break
    need = np.maximum(demand - cover, 0.0)
    for length in used[::-1] if not whole else ():
        while need[length] > 1e-9 * demand[length]:
            config, c = {}, capacity
            for x in used[::-1]:
                if need[x] > 1e-9 * demand[x] and x <= c:
                    config[int(x)] = c // int(x)
                    c %= int(x)
            buy(config, min(need[x] / n for x, n in config.items()), need)
    return Program(columns, prices, bound)


def rounded(program: Program, left: dict[int, int], capacity: int, room: float) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of the program's columns that left can pay, taken from it; amounts are carried from column to column.

    Columns that leave no room come first; the others together may leave `room`.
    """
    made, carry = [], 0.5
    for config, amount in sorted(program.columns, key=lambda c: -sum(x * n for x, n in c[0].items())):
        free = capacity - sum(x * n for x, n in config.items())
        carry += amount
        times = min([int(carry), *(left.get(x, 0) // n for x, n in config.items()), *([max(0, int(room // free))] if free else [])])
        carry -= int(carry)
        if times > 0:
            room -= free * times
            made.append((config, times))
            for x, n in config.items():
                left[x] -= n * times
    return made


def planned(counts: dict[int, int], capacity: int, phases: int = 6) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Whole configurations with their numbers, which use every piece exactly once, and how many entries come from the program.

    The program is solved and rounded; what rounding leaves is bought from the residual program in whole numbers, until
    that is a small share or yields no more; best fit packs the rest. Rounded columns may leave as much room as the
    program's cover does; if that takes more sequences than the tokens fill, it is tried with columns that leave none and
    with other shares.
    """
    counts = {k: v for k, v in counts.items() if v}
    full = [({capacity: 1}, counts.pop(capacity))] if capacity in counts else []
    total = sum(x * n for x, n in counts.items())
    first, tried = linear_program(counts, capacity), []
    for slack, least in ((1.0, 0.08), (0.0, 0.05), (0.0, 0.08), (0.0, 0.12), (0.0, 0.25)):
        left, made = dict(counts), list(full)
        for phase in range(phases):
            before = sum(x * n for x, n in left.items())
            if before <= least * total:
                break
            program = first if not phase else linear_program(left, capacity, 2, whole=True, seed=9 + phase)
            made += rounded(program, left, capacity, slack * program.room(capacity))
            left = {k: v for k, v in left.items() if v}
            if phase and sum(x * n for x, n in left.items()) > 0.9 * before:
                break
        tried.append((made + best_fit(left, capacity), len(made)))
        if sum(times for _, times in tried[-1][0]) <= sum(times for _, times in full) - (-total // capacity):
            break
    return min(tried, key=lambda p: sum(times for _, times in p[0]))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations with their numbers, which use every piece exactly once."""
    return planned(counts, capacity)[0]


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on a histogram: equal bins are kept as one configuration with a number."""
    room: list[int] = []
    bins: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(free: int, config: dict[int, int], times: int) -> None:
        if free not in bins:
            bisect.insort(room, free)
        bins.setdefault(free, []).append((config, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(room, size)
            if at == len(room):
                each = capacity // size
                if left // each:
                    put(capacity - each * size, {size: each}, left // each)
                if left % each:
                    put(capacity - left % each * size, {size: left % each}, 1)
                break
            free = room[at]
            config, times = bins[free].pop()
            if not bins[free]:
                del bins[free], room[at]
            each = min(free // size, left)
            used = min(times, left // each)
            put(free - each * size, config | {size: config.get(size, 0) + each}, used)
            if used < times:
                put(free, config, times - used)
            left -= each * used
    return [x for free in room for x in bins[free]]


def slots(made: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each configuration and length in it: the ranks that it takes, and where they go."""
    rows, rank, sequence = [], {}, 0
    for config, times in made:
        at = 0
        for size in sorted(config, reverse=True):
            lo, each = rank.get(size, 0), config[size]
            rank[size] = lo + each * times
            rows.append((size, lo, rank[size], each, sequence, at))
            at += size * each
        sequence += times
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "each", "first_sequence", "at"], dtype="int64")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of documents(doc_id, text) with sequence_id and offset; see the module's text."""
    spark = documents.sparkSession
    small_batches(spark)
    cut = written(pieces(documents, path, capacity), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = min(100_000, max(64, sum(counts.values()) // 20_000))
    table = slots(plan(counts, capacity))
    if not len(table):
        return cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    places = spark.createDataFrame(table)
    # A row is salted by its place in the written table: rows of one id, null ids and repeated rows are dealt like any others.
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("_metadata.file_name", "_metadata.row_index"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    # Rows for the program's columns, whose number depends on `capacity` and the distinct lengths alone.
    placed = ranked.join(F.broadcast(places) if len(table) <= BROADCAST_ROWS else places, "length").where("rank >= lo and rank < hi")
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )
