"""Cutting lineage in iterative plans, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table up to which it is sent to all executors; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
#: Rows that one pass over a larger join shuffles, about; passes run one after the other, so that their shuffles don't add up on disk.
PASS_ROWS = 50_000_000
#: Kinds of ids, what stands before the colon, by which edges are told apart before a join; where there are more, they are not.
KINDS = 1000
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder.

    What reads it starts from a file scan, which knows its size: a checkpoint would inherit the size estimated for the
    plan that made it, and in a loop that uses its table several times the digits of that number multiply each round.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANED, "false")
    conf.set(CLEANED, "true")  # the plan's shuffles go once it is written, not when the driver next collects garbage
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a cut table, as it is counted), marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def kind_of(node: str) -> Column:
    return F.substring_index(node, ":", 1)


def kind_pairs(ends: DataFrame, start: str, end: str) -> dict[tuple[str, str], int] | None:
    """How many of ends lead from a kind of ids to a kind, or None if there are too many kinds to tell edges apart by them."""
    counts = ends.groupBy(kind_of(start).alias("a"), kind_of(end).alias("b")).agg(F.count("*").alias("n")).limit(KINDS + 1).collect()
    return {(r["a"], r["b"]): r["n"] for r in counts} if len(counts) <= KINDS else None


def part_of(node: str, passes: int, i: int) -> Column:
    """Whether a node's turn is in this pass."""
    return F.lit(True) if passes == 1 else F.pmod(F.xxhash64(node), F.lit(passes)) == i


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
