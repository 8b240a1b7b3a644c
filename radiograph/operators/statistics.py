"""How far predicted confidences can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brier(rows: DataFrame) -> DataFrame:
    """(brier): the mean squared error of rows(p, actual), to four places; 0 for none."""
    return rows.agg(F.round(F.coalesce(F.avg(F.pow(F.col("p") - F.col("actual"), 2)), F.lit(0.0)), 4).alias("brier"))


def calibration_curve(rows: DataFrame, buckets: int = 10, tolerance: float = 0.15, least: int = 10) -> DataFrame:
    """One row per bucket of predicted values, empty ones too: count, means, error, whether it is within the tolerance."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))
    found = rows.select(F.least(F.floor(p * buckets), F.lit(buckets - 1)).cast("long").alias("bucket"), p.alias("p"), "actual")
    sums = found.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.avg("actual").alias("accuracy"))
    error = F.abs(F.col("mean") - F.col("accuracy"))
    out = rows.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(sums, "bucket", "left")
    return out.select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 4).alias("mean"), F.round("accuracy", 4).alias("accuracy"), F.round(error, 4).alias("error"), (F.coalesce("n", F.lit(0)) < least).alias("too_few"), F.when(F.coalesce("n", F.lit(0)) < least, True).otherwise(error <= tolerance).alias("within"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval, to four places; zeros for n = 0."""
    p, size = hits / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    below = 1 + z * z / size
    centre, half = p + z * z / (2 * size), z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return F.coalesce(F.round(F.greatest(F.lit(0.0), (centre - half) / below), 4), F.lit(0.0)), F.coalesce(F.round(F.least(F.lit(1.0), (centre + half) / below), 4), F.lit(0.0))


def by_type(rows: DataFrame, gate: float = 0.7) -> DataFrame:
    """Per kind of rows(kind, actual BOOLEAN): hits, misses, unknown; precision over the known, recall over all, Wilson bounds, gate."""
    count = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    sums = rows.groupBy("kind").agg(F.count("*").alias("n"), count("actual").alias("tp"), count("not actual").alias("fp"), count("actual is null").alias("unknown"))
    lower, upper = wilson(F.col("tp"), F.col("n"))
    precision = F.coalesce(F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 4), F.lit(0.0))
    return sums.select("kind", "n", "tp", "fp", "unknown", precision.alias("precision"), F.round(F.col("tp") / F.col("n"), 4).alias("recall"), lower.alias("lower"), upper.alias("upper"), (lower >= gate).alias("passed"))


def bucket_label(bucket: Column, buckets: int = 10) -> Column:
    """`[0.1, 0.2)`; the last bucket is closed."""
    return F.concat(F.format_string("[%.1f, %.1f", bucket / F.lit(float(buckets)), (bucket + 1) / F.lit(float(buckets))), F.when(bucket == buckets - 1, "]").otherwise(")"))


def calibration_report(rows: DataFrame, tolerance: float = 0.15, least: int = 10) -> DataFrame:
    """One row: samples, Brier score, buckets with enough samples, and whether all of these are within the tolerance (true for none)."""
    curve = calibration_curve(rows, 10, tolerance, least)
    gates = curve.agg(F.sum("n").cast("long").alias("samples"), F.sum((~F.col("too_few")).cast("long")).alias("adequate"), F.coalesce(F.every(F.when(~F.col("too_few"), F.col("within"))), F.lit(True)).alias("passed"))
    return gates.crossJoin(brier(rows))


def thresholds_met(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Per kind with a threshold of rows(kind, actual BOOLEAN): precision, lower bound, and whether precision reaches the threshold."""
    wanted = rows.sparkSession.createDataFrame(sorted(thresholds.items()), "kind string, least double")
    found = by_type(rows).select("kind", "n", "precision", "lower")
    return F.broadcast(wanted).join(found, "kind", "left").select("kind", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("lower", F.lit(0.0)).alias("lower"), (F.coalesce("precision", F.lit(0.0)) >= F.col("least")).alias("passed"))


def verdict(scores: DataFrame, spots: DataFrame) -> DataFrame:
    """One row of gates over scores(root, tp, fn, fp, ...) of relations.evaluated() and spots(root, n), the blind spots told for each root.

    Recall from 0.90, precision and agreement from 0.85, no false negative, and blind spots told for every root.
    """
    every, each = scores.where("root = 'all'"), scores.where("root <> 'all'").select("root")
    untold = each.join(spots.where("n > 0").select("root"), "root", "left_anti").agg(F.count("*").alias("untold"))
    agreement = F.coalesce(F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 4), F.lit(1.0))
    gates = every.crossJoin(untold).select(
        "tp", "fn", "fp", "recall", "precision", agreement.alias("agreement"), (F.col("recall") >= 0.9).alias("recall_gate"), (F.col("precision") >= 0.85).alias("precision_gate"),
        (agreement >= 0.85).alias("agreement_gate"), (F.col("fn") == 0).alias("no_miss_gate"), (F.col("untold") == 0).alias("told_gate"),
    )
    passed = F.col("recall_gate") & F.col("precision_gate") & F.col("agreement_gate") & F.col("no_miss_gate") & F.col("told_gate")
    return gates.withColumn("verdict", F.when(passed, "PASSED_VALIDATION").otherwise("FAILED_KILL_CHECK"))


def clustering_gates(ari: DataFrame, modularity: DataFrame, least_ari: float = 0.6, least_q: float = 0.3) -> DataFrame:
    """One row: ari, q, and whether each reaches its gate."""
    return ari.crossJoin(modularity).select("ari", "q", (F.col("ari") >= least_ari).alias("ari_gate"), (F.col("q") >= least_q).alias("q_gate"))
