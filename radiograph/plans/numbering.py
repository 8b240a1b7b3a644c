"""Places in a total order without one task, and pairing by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Bits of a running number that count within its partition.
_WITHIN = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 1: sorted by ranges, numbered within each, after the counts of the ranges before.

    The order should be total; rows that it leaves equal may come either way.
    """
    held = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_run", F.monotonically_increasing_id()))
    part = F.shiftright("_run", _WITHIN)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # one row for each range
    within = F.col("_run") - F.shiftleft(part, _WITHIN)
    return held.withColumn("_part", part).join(F.broadcast(offsets), "_part").select(*rows.columns, (F.col("_before") + within + 1).cast("long").alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """The rows of both lists paired by their places, with `place`; lists of unequal length are an error, as a pairing would be wrong from the first gap on."""
    a, b = cut(numbered(left, left_order)), cut(numbered(right, right_order))
    lengths = a.count(), b.count()
    if lengths[0] != lengths[1]:
        raise ValueError(f"lists of {lengths[0]} and {lengths[1]} rows can't be paired by place")
    return a.join(b, "place")
