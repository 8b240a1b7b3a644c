"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations of the principal axes are learned on a bounded sample so that the signs of a vector's rotated coordinates lose
little (Gong and Lazebnik, 2011); where more bits are asked for than there are dimensions, further rotations follow. A
code has as many chunks as it takes to meet 99 of 100 pairs at the least cosine on some chunk up to one wrong bit, and a
chunk about as many bits as the number of vectors, so that buckets don't grow with it. One side enters each chunk's value
as it is, the other the value and its neighbours one bit away; by the pigeonhole principle all codes that differ in
fewer than twice as many bits as there are chunks meet. Every pair is taken at its first such chunk only.

Candidates are reranked by the cosine of the original vectors in double precision; equal vectors of a label are one
class with a number of members. Pairs of crowded buckets never become rows: their vectors are gathered in blocks of
about `BLOCK`, and each pair of blocks gives a number of links for each vector and its component within the blocks.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id, link
with nothing; a null vec_id keeps a null component_id and counts as kept. Vectors of different lengths never link.
Rows that repeat a vec_id count as one node; if they hold different vectors, n_links counts the links of each. Labels are compared as text. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected_components, small_batches, written

LEAST_COSINE = 0.98
#: Share of the pairs at the least cosine that may be missed, by which the number of chunks is chosen.
MISSED = 0.01
#: Vectors on which the rotations are learned.
SAMPLE_ROWS = 10_000
#: Vectors of a bucket from which on it and its neighbours count as crowded, and vectors in a block.
CROWDED, BLOCK = 32, 256


def tables(n: int, least: float = LEAST_COSINE) -> tuple[int, int]:
    """(chunks, bits of each) for n vectors; a bit differs with a probability of angle over pi."""
    bits = min(40, max(12, math.ceil(math.log2(max(n, 2)))))
    flip = math.acos(least) / math.pi
    met = (1 - flip) ** bits + bits * flip * (1 - flip) ** (bits - 1)
    return max(2, math.ceil(math.log(MISSED) / math.log(1 - met) - 0.25)), bits


def learned_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal axes times the rotations that iterative quantisation finds, each of at most as many bits as dimensions."""
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    axes, parts = axes[:, ::-1], []
    for lo in range(0, bits, axes.shape[1]):
        own = axes[:, : min(axes.shape[1], bits - lo)]
        v = (x - mean) @ own
        r = np.linalg.qr(np.random.default_rng(seed + lo + 1).normal(size=(own.shape[1], own.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        parts.append(own @ r)
    return mean, np.concatenate(parts, 1)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a double matrix with one row per usable vector, and which rows are usable (those of the first one's length)."""
    rows = column.to_pylist()
    good = np.array([v is not None and len(v) > 0 and None not in v for v in rows], bool)
    length = len(rows[int(np.flatnonzero(good)[0])]) if good.any() else 1
    good &= np.array([v is not None and len(v) == length for v in rows], bool)
    x = np.array([rows[i] for i in np.flatnonzero(good)], float).reshape(-1, length)
    with np.errstate(over="ignore", invalid="ignore"):
        fine = np.isfinite(x).all(1) & (np.abs(x) > 0).any(1)
    good[np.flatnonzero(good)[~fine]] = False
    return x[fine], good


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: the vectors that can link; label holds the length too."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    return rows.withColumn("label", F.concat_ws(":", F.size("v").cast("string"), "label"))


def coded(vectors: DataFrame, mean: np.ndarray, projection: np.ndarray, chunks: int) -> DataFrame:
    """key, vec_id, label, members, the unit vector u, and the code's chunks c0, c1, ...; a vector of another length than the learned ones gets the code of its padded or cut form."""
    names = [f"c{i}" for i in range(chunks)]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_048):
                part = batch.slice(lo, 2_048)
                rows = [np.array(v) for v in part.column(4).to_pylist()]
                units = [v / np.linalg.norm(v) for v in (v / np.abs(v).max() for v in rows)]
                x = np.array([np.pad(v[:d], (0, max(0, d - len(v)))) for v in units]).reshape(-1, d)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                bits = ((x - mean) @ projection >= 0).reshape(len(x), chunks, -1)
                codes = (bits * (1 << np.arange(bits.shape[2], dtype=np.int64))).sum(2)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(units, pa.list_(pa.float64())), *(pa.array(codes[:, i].copy()) for i in range(chunks))], names=["key", "vec_id", "label", "members", "u", *names])

    return vectors.select("key", "vec_id", "label", "members", "v").mapInArrow(code, f"key long, vec_id long, label string, members long, u array<double>, {', '.join(f'{c} long' for c in names)}")


def entered(codes: DataFrame, chunks: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(table, asked): each vector's buckets (label, chunk, value) as they are, and with their neighbours one bit away."""
    names = [f"c{i}" for i in range(chunks)]
    table = codes.select("key", "vec_id", "label", *names, F.posexplode(F.array(*names)).alias("chunk", "value"))
    near = F.expr(f"concat(array(value), transform(sequence(0, {bits - 1}), k -> value ^ shiftleft(1L, k)))")
    return table, table.withColumn("value", F.explode(near))


_BUCKET = ["label", "chunk", "value"]


def crowded_buckets(table: DataFrame, bits: int) -> DataFrame:
    """(label, chunk, value) of the buckets in which CROWDED vectors or more stand, or next to which they do."""
    full = table.groupBy(*_BUCKET).count().where(F.col("count") >= CROWDED)
    near = F.expr(f"concat(array(value), transform(sequence(0, {bits - 1}), k -> value ^ shiftleft(1L, k)))")
    return full.withColumn("value", F.explode(near)).select(*_BUCKET).distinct()


def candidate_pairs(table: DataFrame, asked: DataFrame, chunks: int) -> DataFrame:
    """(x_key, y_key) of equal labels whose codes agree on a chunk up to one bit: each pair once, the smaller vec_id first."""
    x, y = table.alias("x"), asked.alias("y")
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.chunk") == F.col("y.chunk")) & (F.col("x.value") == F.col("y.value"))
    first = " ".join(f"when bit_count(x.c{i} ^ y.c{i}) <= 1 then {i}" for i in range(chunks))
    return x.join(y, same & F.expr(f"x.vec_id < y.vec_id and case {first} end = x.chunk")).select(F.col("x.key").alias("x_key"), F.col("y.key").alias("y_key"))


def reranked(pairs: DataFrame, codes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(a, b, na, nb): the pairs whose cosine in double precision is at least `least`, with the members of both."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            sizes = np.diff(np.asarray(batch.column(4).offsets))
            x, y = (np.asarray(batch.column(i).flatten(), float) for i in (4, 5))  # of equal lengths, as the labels are equal
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for lo in range(0, len(at), 4096):
                    part = at[lo : lo + 4096]
                    places = starts[part][:, None] + np.arange(d)
                    ok[part] = (x[places] * y[places]).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in range(4)], names=["a", "b", "na", "nb"])

    one = codes.select(F.col("key").alias("y_key"), F.col("vec_id").alias("b"), F.col("u").alias("y"), F.col("members").alias("nb"))
    two = codes.select(F.col("key").alias("x_key"), F.col("vec_id").alias("a"), F.col("u").alias("x"), F.col("members").alias("na"))
    return pairs.join(one, "y_key").join(two, "x_key").select("a", "b", "na", "nb", "x", "y").mapInArrow(keep, "a long, b long, na long, nb long")


def linked_blocks(table: DataFrame, asked: DataFrame, codes: DataFrame, chunks: int, least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n, root): for pairs of blocks of crowded buckets, how many vectors each one links with and the smallest it reaches there."""
    names = [f"c{i}" for i in range(chunks)]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = bounded(written(rows.groupBy(*_BUCKET).agg(F.expr(f"cast((count(1) + {BLOCK - 1}) div {BLOCK} as int)").alias("blocks")), "sizes"))
        rows = rows.select("key", *_BUCKET).join(sizes, _BUCKET).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        held = F.collect_list(F.struct("vec_id", "members", *names, "u")).alias(name)
        return written(rows.join(codes.drop("label"), "key").groupBy(*_BUCKET, "block").agg(held).drop("block"), name)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                chunk = batch.column(0)[r].as_py()
                sides = []
                for column in (batch.column(1), batch.column(2)):
                    rows = column.slice(r, 1).flatten()
                    sides.append(([np.asarray(rows.field(i)) for i in range(2 + chunks)], np.asarray(rows.field(2 + chunks).flatten(), float).reshape(len(rows), -1)))
                (x, u), (y, v) = sides
                ok = (u @ v.T >= least) & (x[0][:, None] < y[0][None, :])
                for i in range(chunk):  # met before
                    ok &= np.bitwise_count(x[2 + i][:, None] ^ y[2 + i][None, :]) > 1
                if not ok.any():
                    continue
                root_x, root_y = x[0].copy(), np.full(len(y[0]), np.iinfo(np.int64).max)
                while True:
                    best_y = np.minimum(root_y, np.where(ok, root_x[:, None], np.iinfo(np.int64).max).min(0))
                    best_x = np.minimum(root_x, np.where(ok, best_y[None, :], np.iinfo(np.int64).max).min(1))
                    if (best_x == root_x).all() and (best_y == root_y).all():
                        break
                    root_x, root_y = best_x, best_y
                for ids, n, root, some in ((x[0], ok @ y[1], root_x, ok.any(1)), (y[0], x[1] @ ok, root_y, ok.any(0))):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], names=["vec_id", "n", "root"])

    both = blocks(table, "x").join(blocks(asked, "y"), _BUCKET).select("chunk", "x", "y")
    return both.mapInArrow(link, "vec_id long, n long, root long")


def near_duplicate_vectors(embeddings: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """One row per row of embeddings(vec_id, embedding, label): vec_id, n_links, component_id, kept; see the module's text."""
    small_batches(embeddings.sparkSession)
    vectors = written(usable(embeddings).withColumn("k", F.sha2(F.to_json("v"), 256)), "vectors")
    sample = vectors.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow().column("v").combine_chunks()
    everyone = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    x, _ = _matrix(sample)
    if len(x) < 2:
        x = np.eye(2)
    classes = written(vectors.groupBy("label", "k").agg(F.min("vec_id").alias("class_id"), F.countDistinct("vec_id").alias("members")), "classes")
    member = written(vectors.select("vec_id", "label", "k").join(classes, ["label", "k"]).select("vec_id", "class_id", "members").distinct(), "members")
    kept = vectors.join(classes.withColumnRenamed("class_id", "vec_id"), ["label", "k", "vec_id"]).dropDuplicates(["vec_id", "label", "k"]).withColumn("key", F.monotonically_increasing_id())
    chunks, bits = tables(classes.count(), least)
    codes = written(coded(kept, *learned_rotation(_units(x), chunks * bits), chunks), "codes")

    table, asked = entered(codes, chunks, bits)
    crowded = bounded(written(crowded_buckets(table, bits), "crowded"))
    pairs = candidate_pairs(table.join(crowded, _BUCKET, "left_anti"), asked.join(crowded, _BUCKET, "left_anti"), chunks)
    links = written(reranked(pairs, codes, least), "links")
    blocks = written(linked_blocks(table.join(crowded, _BUCKET, "left_semi"), asked.join(crowded, _BUCKET, "left_semi"), codes, chunks, least), "blocks")

    direct = links.select(F.col("a").alias("class_id"), F.col("nb").alias("n")).union(links.select("b", "na")).union(blocks.select("vec_id", "n"))
    direct = written(direct.groupBy("class_id").agg(F.sum("n").alias("n")), "direct")
    counts = member.join(direct, "class_id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("members") - 1).cast("long").alias("n_links"))
    whole = connected_components(links.select("a", "b").union(blocks.select("vec_id", "root")).union(member.where("vec_id <> class_id").select("vec_id", "class_id")))
    out = everyone.join(counts, "vec_id", "left").join(whole, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
