"""Language-model scores: prediction by partial matching over bytes, beside a unigram base.

The training rows' bytes (A-Z lower-cased, each text preceded by five zero bytes and ended by one) are counted by
context in Spark. The model is a byte-context trie of depth five: in a context that saw n bytes of d kinds, a byte seen
c times has probability c / (n + d), and d / (n + d) is the escape to the next shorter context (method C), where bytes
that the longer context has seen are excluded; at the end all bytes not seen at all are alike. The trie is a pair of
tables (grams: a context and its byte; contexts) that hold every context of the training rows and grow with them.

A byte known in its longest context has the fixed probability c / (n + d). The `FREQUENT_GRAMS` most frequent of these
are sent to the workers, which look bytes up by array; all other bytes of a text are handed on as (gram, times) and
joined with the trie, where novel grams go through their escapes. What is excluded depends on the longer context alone
(bytes seen there are also seen in the shorter one), so that each context carries the sums that its escape needs.
Token counts for the base work alike: the `FREQUENT` most frequent are sent, others are joined.

Tokens are told apart by 64-bit hashes. Null and empty texts consist of the end token alone. Rows are scored one by one, so
repeated rows repeat their result; extra columns are ignored. Without training rows N, V and c are 0, and the model
is uniform over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _UPPER_TO_LOWER, SLICE_BYTES, remainder, remainder_of, row_slices, small_batches, text_bytes, word_hashes, written

FOLDS = 10
DEPTH = 5
#: Tokens and grams sent to the workers; all others are joined in Spark.
FREQUENT, FREQUENT_GRAMS = 1 << 19, 1 << 20
#: The hash that stands for the end token; words cannot have it but by chance.
END = np.uint64(0xE4D0E4D0E4D0E4D1)
#: Distinct entries that a counting task gathers before it hands them on.
GATHERED = 2_000_000
TOKEN, GRAM = 0, 1


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row of each byte to predict, and its five bytes of context and itself as one number; slice by slice."""
    sizes = np.diff(offsets)
    blocks = np.concatenate([[0], np.cumsum(sizes + DEPTH + 1)])
    out = np.zeros(blocks[-1], np.uint8)
    for i in range(len(sizes)):
        out[blocks[i] + DEPTH : blocks[i + 1] - 1] = _UPPER_TO_LOWER[data[offsets[i] : offsets[i + 1]]]
    for lo in range(DEPTH, len(out), SLICE_BYTES):
        hi = min(len(out), lo + SLICE_BYTES)
        code = np.zeros(hi - lo, np.uint64)
        for back in range(DEPTH, -1, -1):
            code = (code << np.uint64(8)) | out[lo - back : hi - back]
        first, last = np.searchsorted(blocks, [lo, hi - 1], "right") - 1
        bounds = np.clip(blocks[first : last + 2], lo, hi)
        rows = np.repeat(np.arange(first, last + 1), np.diff(bounds))
        inside = np.arange(lo, hi) - blocks[rows] >= DEPTH
        yield rows[inside], code[inside]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and grams of training rows with their counts."""

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 50_000):
            k = keys[lo : lo + 50_000].astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[lo : lo + 50_000])], names=["kind", "key", "n"])

    held: dict[int, list] = {TOKEN: [], GRAM: []}
    sizes = {TOKEN: 0, GRAM: 0}
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in row_slices(offsets):
            chosen = np.array([i for i in range(lo, hi) if remainder_of(ids[i], FOLDS)], np.int64)
            if not len(chosen):
                continue
            own = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in chosen])
            at = np.concatenate([[0], np.cumsum(offsets[chosen + 1] - offsets[chosen])])
            found = [(TOKEN, np.append(word_hashes(own, at)[0], np.full(len(chosen), END)))]
            for kind, keys in (*found, *((GRAM, code) for _, code in grams(own, at))):
                held[kind].append(np.unique(keys, return_counts=True))
                sizes[kind] += len(held[kind][-1][0])
                if sizes[kind] > GATHERED:
                    held[kind] = [_merged(held[kind])]
                    sizes[kind] = len(held[kind][0][0])
                    if 2 * sizes[kind] > GATHERED:
                        yield from out(kind, *held[kind].pop())
                        sizes[kind] = 0
    for kind, parts in held.items():
        if parts:
            yield from out(kind, *_merged(parts))


def _tail(gram: Column, length: Column | int) -> Column:
    """The last so many bytes of a gram."""
    length = F.lit(length) if isinstance(length, int) else length
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (length * 8).cast("int")) - F.lit(1))


def trie(deep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """grams(length, gram, n) and contexts(length, context, total, kinds, below) of the grams (gram, n) of full length.

    below is how often the context's bytes are seen in the next shorter context: what an escape to it excludes.
    """
    lengths = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("length")
    every = deep.select("gram", "n", lengths).groupBy("length", _tail(F.col("gram"), F.col("length") + 1).alias("gram")).agg(F.sum("n").alias("n"))
    every = written(every, "grams")
    shorter = every.select((F.col("length") + 1).alias("length"), F.col("gram").alias("tail"), F.col("n").alias("below"))
    joined = every.withColumn("tail", _tail(F.col("gram"), F.col("length"))).join(shorter, ["length", "tail"], "left")
    contexts = joined.groupBy("length", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum(F.coalesce("below", F.lit(0))).alias("below"))
    return every, written(contexts, "contexts")


#: One step down the trie: s is what the longer contexts left, x the context of this length; n is null where it never saw the byte.
_STEP = """(s, x) -> case
  when s.done then s
  when x.n is not null then named_struct('mass', s.mass + log10(x.n / (x.total - s.below + x.kinds - s.kinds)), 'done', true, 'kinds', 0L, 'below', 0L)
  when x.total is null or x.total = s.below then named_struct('mass', s.mass, 'done', false, 'kinds', coalesce(x.kinds, 0L), 'below', coalesce(x.below, 0L))
  else named_struct('mass', s.mass + log10((x.kinds - s.kinds) / (x.total - s.below + x.kinds - s.kinds)), 'done', false, 'kinds', x.kinds, 'below', x.below) end"""


def escaped(novel: DataFrame, every: DataFrame, contexts: DataFrame) -> DataFrame:
    """(gram, value): the log10 probability of each distinct gram of novel(gram), by escapes from the longest context on.

    Contexts of at most one byte are at most 257, and their grams at most 65,792: these are broadcast, as all grams ask
    for them; longer ones are joined by shuffles.
    """
    asked = novel.select("gram", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("length"))
    asked = asked.withColumn("context", _tail(F.shiftright("gram", 8), F.col("length"))).withColumn("part", _tail(F.col("gram"), F.col("length") + 1))
    parts = every.withColumnRenamed("gram", "part")
    steps = None
    for which, mark in (("length <= 1", F.broadcast), ("length > 1", lambda df: df)):
        own = asked.where(which).join(mark(contexts.where(which)), ["length", "context"], "left").join(mark(parts.where(which)), ["length", "part"], "left")
        own = own.select("gram", F.struct((-F.col("length")).alias("order"), "n", "total", "kinds", "below").alias("step"))
        steps = own if steps is None else steps.unionByName(own)
    begin = "named_struct('mass', 0D, 'done', false, 'kinds', 0L, 'below', 0L)"
    ended = "s -> s.mass - if(s.done, 0D, log10(256 - s.kinds))"
    return steps.groupBy("gram").agg(F.sort_array(F.collect_list("step")).alias("steps")).select("gram", F.expr(f"aggregate(steps, {begin}, {_STEP}, {ended})").alias("value"))


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most so many: all above a level, so that no task sorts or gathers them.

    Levels are sixteenths of a power of two; there are at most a thousand, whatever the input.
    """
    level = F.floor(F.log2(F.col(count)) * 16)
    sizes = {r["level"]: r["size"] for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    for at in sorted(sizes, reverse=True):
        held += sizes[at]
        if held > most:
            break
        least = at
    return rows.where(level >= least)


def _sent(rows: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their values."""
    table = rows.select(key, value).toArrow()
    keys, values = table[key].to_numpy().astype(np.int64).view(np.uint64), table[value].to_numpy().astype(float)
    order = np.argsort(keys)
    return keys[order], values[order]


def looked_up(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are known, and their values; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    found = known[place] == keys
    return found, np.where(found, values[place], 0.0)


def counted_pairs(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, key) and how often each occurs."""
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], keys[first], np.diff(np.append(first, len(rows)))


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of documents(doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = written(documents.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counted")
    tokens = counted.where(F.col("kind") == TOKEN).select("key", "n", F.log10(F.col("n") + F.lit(0.1)).alias("value"))
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    every, contexts = trie(counted.where(F.col("kind") == GRAM).select(F.col("key").alias("gram"), "n"))
    longest = contexts.where(F.col("length") == DEPTH).select("context", "total", "kinds")
    seen = every.where(F.col("length") == DEPTH).withColumn("context", F.shiftright("gram", 8)).join(longest, "context")
    seen = written(seen.select("gram", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("value")), "seen")
    sent = spark.sparkContext.broadcast((_sent(most_frequent(tokens, "n", FREQUENT), "key", "value"), _sent(most_frequent(seen, "n", FREQUENT_GRAMS), "gram", "value")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in row_slices(offsets):
                own, at, n = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], hi - lo
                words, counts = word_hashes(own, at)
                rows = np.concatenate([np.repeat(np.arange(n), counts), np.arange(n)])
                sums, known, left = np.zeros((2, n)), np.zeros(n, np.int64), []
                for kind, which, keys in ((TOKEN, rows, np.append(words, np.full(n, END))), *((GRAM, r, c) for r, c in grams(own, at))):
                    distinct_keys, back = np.unique(keys, return_inverse=True)
                    found, values = looked_up(*sent.value[kind], distinct_keys)
                    found = found[back]
                    sums[kind] += np.bincount(which, values[back], n)
                    if kind == TOKEN:
                        known += np.bincount(which[found], minlength=n)
                    row, key, times = counted_pairs(which[~found], keys[~found])
                    left.append((row, np.full(len(row), kind, np.int32), key.view(np.int64), times))
                row, kind, key, times = (np.concatenate(x) for x in zip(*left, strict=True))
                order = np.argsort(row, kind="stable")
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (kind, key, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(counts + 1), pa.array(known), pa.array(sums[TOKEN]), pa.array(sums[GRAM]), *lists],
                    names=["doc_id", "n_tokens", "n_known", "base", "score", "kinds", "keys", "times"],
                )

    judged = documents.mapInArrow(judge, "doc_id long, n_tokens long, n_known long, base double, score double, kinds array<int>, keys array<long>, times array<long>")
    judged = written(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    left = judged.select("row", F.explode(F.arrays_zip("kinds", "keys", "times")).alias("e")).select("row", F.col("e.kinds").alias("kind"), F.col("e.keys").alias("key"), F.col("e.times").alias("times"))
    asked = left.where(F.col("kind") == GRAM).select(F.col("key").alias("gram")).distinct()
    valued = written(asked.join(seen.select("gram", "value"), "gram", "left"), "asked")
    novel = escaped(valued.where("value is null").select("gram"), every, contexts)
    values = tokens.select(F.lit(TOKEN).alias("kind"), "key", "value").unionByName(
        valued.where("value is not null").union(novel).select(F.lit(GRAM).alias("kind"), F.col("gram").alias("key"), "value")
    )
    is_token, worth = F.col("kind") == TOKEN, F.coalesce("value", F.log10(F.lit(0.1))) * F.col("times")
    more = left.join(values, ["kind", "key"], "left").groupBy("row").agg(
        F.sum(F.when(is_token, worth)).alias("more_base"), F.sum(F.when(is_token & F.col("value").isNotNull(), F.col("times"))).alias("more_known"), F.sum(F.when(~is_token, worth)).alias("more_score")
    )
    out = judged.drop("kinds", "keys", "times").join(more, "row", "left")
    constant = float(np.log10(total + 0.1 * (distinct + 1)))
    plus = lambda column, name: F.col(column) + F.coalesce(name, F.lit(0))
    return out.select(
        "doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (plus("base", "more_base") - F.lit(constant) * F.col("n_tokens")).alias("base_score"), plus("score", "more_score").alias("score"),
    )
