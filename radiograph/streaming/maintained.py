"""A graph kept up to date from a stream of changed files, by what each change takes away and adds.

The state of a file is its newest version and what that refers to. A newer version emits the difference to it, +1 for each
new reference and -1 for each that is gone; a version that is older than the held one, however late it comes, emits
nothing. Differences are appended batch by batch, in a folder of its own that a repeated batch overwrites, and the graph is
their sum: nothing is read again or rewritten for a change but the state of its file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_DELTA, _STATE = "source string, target string, delta long", "changed long, targets string"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a file's versions in a batch change; targets is a text of lines, null for a deleted file."""
    held = state.get if state.exists else None
    newest = None
    for frame in frames:
        for changed, targets in zip(frame["changed"], frame["targets"], strict=True):
            version = (int(changed), "" if pd.isna(targets) else str(targets))
            newest = version if newest is None or version > newest else newest
    if newest is None or (held is not None and newest <= (held[0], held[1])):
        return
    before, after = (Counter(t for t in x.split("\n") if t) for x in (held[1] if held else "", newest[1]))
    state.update(newest)
    moved = {t: after[t] - before[t] for t in before | after if after[t] != before[t]}
    if moved:
        yield pd.DataFrame({"source": [f"file:{key[0]}"] * len(moved), "target": list(moved), "delta": list(moved.values())})


def maintain(files: DataFrame, targets: Callable[[Column], Column], folder: str) -> StreamingQuery:
    """Start a stream of files(path, content, changed TIMESTAMP) into folder; null content deletes a file, null paths count nowhere.

    targets gives the references in a content, as an array of text without line breaks.
    """
    listed = F.when(F.col("content").isNotNull(), F.array_join(targets(F.col("content")), "\n"))
    rows = files.where("path is not null").select("path", F.unix_micros("changed").alias("changed"), listed.alias("targets"))
    deltas = rows.groupBy("path").applyInPandasWithState(_changes, _DELTA, _STATE, "update", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("source", "target").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch_id}")

    return deltas.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """(source, target, n): the references that all files have now; n tells how often."""
    sums = spark.read.schema("source string, target string, delta long").parquet(f"{folder}/deltas").groupBy("source", "target").agg(F.sum("delta").alias("n"))
    return sums.where("n <> 0")


def graph_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """(target, n_references, n_files): how much every target is referred to now."""
    return graph_edges(spark, folder).groupBy("target").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_files"))
