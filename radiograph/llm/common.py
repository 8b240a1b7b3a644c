"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; bounds the memory of a worker whatever the Arrow batch holds.
SLICE_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
#: Rows that Spark's Parquet reader holds at once: with Spark's 4,096, long texts take arrays of tens of MB in each task.
READ_ROWS = 512
#: Rows of narrow tables up to which they are sent to all executors instead of shuffled; `bounded` counts them.
BROADCAST_ROWS = 500_000

_UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
_UPPER_TO_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-checkpoints-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to a Python worker at once by BATCH_BYTES, and what it reads at once by READ_ROWS, where the session allows more."""
    for setting, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if int(spark.conf.get(setting, str(most + 1)).removesuffix("b")) > most:
            spark.conf.set(setting, str(most))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the row offsets into them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes and at most so many rows each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), so that every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Powers of the step: low for places within a block of 65,536 bytes, high for the number of such blocks before it.
_LOW_POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(65535, _STEP | np.uint64(1), np.uint64)]))
_BLOCK_STEP = (_LOW_POWERS[-1:] * (_STEP | np.uint64(1)))[0]


def _powers(places: np.ndarray) -> np.ndarray:
    """The step's powers for places within a word, however long it is."""
    out = _LOW_POWERS[places & 65535]
    blocks = places >> 16
    if len(blocks) and (most := int(blocks.max())):
        out = out * np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(most, _BLOCK_STEP, np.uint64)]))[blocks]
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and the number of words of each row.

    Bytes are read in blocks of SLICE_BYTES; a word that goes on in the next block is carried over as its sum and
    length, so that memory is bounded whatever the length of a text or a word.
    """
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    total, carried_sum, carried = int(offsets[-1]), np.uint64(0), 0
    for a in range(0, total, SLICE_BYTES):
        b = min(total, a + SLICE_BYTES)
        raw = _UPPER_TO_LOWER[data[a:b]]
        space = _IS_SPACE[raw]
        before = np.empty(len(raw), bool)
        before[0], before[1:] = True, space[:-1]
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        before[rows] = True
        inside = ~space
        starts = np.flatnonzero(inside & before)
        if not len(starts):
            continue
        kept = raw[inside]
        first = (np.cumsum(inside) - 1)[starts]
        lengths = np.diff(np.append(first, len(kept)))
        place = np.arange(len(kept)) - np.repeat(first, lengths)
        if carried:  # the block begins within a word
            place[: lengths[0]] += carried
        sums = np.add.reduceat(_BYTE_VALUE[kept] * _powers(place), first)
        if carried:
            sums[:1] += carried_sum
            lengths[0] += carried
        ended, carried = len(starts), 0
        if b < total and inside[-1] and not _IS_SPACE[data[b]] and offsets[np.searchsorted(offsets, b)] != b:
            ended, carried_sum, carried = ended - 1, sums[-1], int(lengths[-1])
        counts += np.bincount(np.searchsorted(offsets, starts[:ended] + a, "right") - 1, minlength=len(counts))[: len(counts)]
        parts.append(mixed(sums[:ended] + lengths[:ended].astype(np.uint64)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def remainder(column: str, by: int):
    """crc32 of an id's decimal text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "utf-8")), F.lit(by))


def remainder_of(value: object, by: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % by


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written or checkpointed table) marked for broadcast if it has at most so many rows, else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b): root is the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) as joins and minima until nothing changes, in a
    number of rounds that grows with the logarithm of the longest path; it raises if `most_rounds` don't suffice. A node
    with very many neighbours is never gathered: minima are combined before the shuffle. They are sent to all executors
    while the edges are at most half of BROADCAST_ROWS, and what is shuffled then is read by one task for each core, since
    hundreds of tasks with a few rows each cost an executor a page of memory apiece, every round; beyond that they are
    checkpointed before they are joined, so that Spark can split such a node's rows over tasks.
    """
    shared_folder(edges.sparkSession)
    cores = edges.sparkSession.sparkContext.defaultParallelism
    stars = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    )
    before = (stars.count(),)
    for _ in range(most_rounds):
        few = before[0] <= BROADCAST_ROWS // 2  # a round doesn't add edges; an edge has two nodes
        stars = stars.coalesce(cores) if few else stars
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(F.broadcast(least.coalesce(cores)) if few else least.checkpoint(), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = large.coalesce(cores) if few else large.checkpoint()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        down = down.coalesce(cores) if few else down.checkpoint()
        small = large.join(F.broadcast(down) if few else down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(down.select("a", "m")).distinct()
        stars = (small.coalesce(cores) if few else small).checkpoint()
        now = tuple(stars.agg(F.count("*"), F.sum("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components have not converged in {most_rounds} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
