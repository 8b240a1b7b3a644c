"""Incremental re-scan: changed files arrive as a stream; what is extracted from a file replaces what it gave before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rescan(files: DataFrame, extract: Callable[[DataFrame], DataFrame], folder: str) -> StreamingQuery:
    """Start a stream of files(path, content, changed TIMESTAMP) into folder; null content deletes a file.

    Each micro-batch writes the newest version of its files (`versions`) and the rows that extract(path, content, version)
    returns for them (`rows`), in a folder of its own that a repeated batch overwrites, so that a restart repeats nothing.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max(F.struct("changed", "content")).alias("b")).select("path", "b.content", "b.changed", F.lit(batch_id).cast("long").alias("version"))
        newest.select("path", "changed", "version", F.col("content").isNull().alias("gone")).write.mode("overwrite").parquet(f"{folder}/versions/batch={batch_id}")
        extract(newest.where("content is not null").select("path", "content", "version")).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of every file's newest version; files whose newest version is a deletion have none."""
    versions = spark.read.parquet(f"{folder}/versions").groupBy("path").agg(F.max(F.struct("changed", "version", "gone")).alias("b"))
    newest = versions.where("not b.gone").select("path", "b.version")
    return spark.read.parquet(f"{folder}/rows").drop("batch").join(newest, ["path", "version"], "left_semi")
