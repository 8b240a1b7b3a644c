"""Foreign keys guessed from column names, and their merge with declared ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import candidate_tables, singularize
from ..schema import BASE_C4, INFERRED_NAMING


def infer(tables: DataFrame, columns: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """(source, target, c4, match_type, evidence): edges guessed from columns(full_name, column) over tables(full_name, schema, name, seq).

    A table is found under its name, and under what follows the first underscore unless an earlier table has that key.
    Targets of the source's schema are preferred; a table's own key is no edge; pairs of declared(source, target) are
    left out; per pair the best guess stays, and the evidence names the first column that led to it.
    """
    bare = tables.select("full_name", "schema", F.lower("name").alias("bare"), "seq")
    named = bare.select(F.col("bare").alias("key"), F.col("full_name").alias("target"), F.col("schema").alias("target_schema"), "seq", F.lit(0).alias("suffix"))
    tail = F.regexp_extract("bare", "^[^_]*_(.+)$", 1)
    tails = bare.select(tail.alias("key"), F.col("full_name").alias("target"), F.col("schema").alias("target_schema"), "seq", F.lit(1).alias("suffix")).where("key <> ''")
    both = named.unionByName(tails)
    first = Window.partitionBy("key").orderBy("seq", "suffix", "target")
    lookup = both.withColumn("rank", F.row_number().over(first)).where("suffix = 0 or rank = 1").select("key", "target", "target_schema")

    stems = columns.select("full_name", F.lower(F.regexp_extract("column", "(?i)^(.+?)_id$", 1)).alias("stem")).where("stem <> ''").distinct()
    source = stems.join(bare, "full_name").select(F.col("full_name").alias("source"), "schema", "bare", "stem")
    asked = source.select("source", "schema", "bare", "stem", F.explode(candidate_tables(F.col("stem"))).alias("c"))
    hits = asked.join(lookup, F.col("c.name") == F.col("key")).withColumn("same", (F.col("schema") == F.col("target_schema")).cast("int"))
    hits = hits.withColumn("any_same", F.max("same").over(Window.partitionBy("source", "stem", "key"))).where("same = any_same")
    own_key = (F.col("source") == F.col("target")) & ((F.col("stem") == F.col("bare")) | (F.col("stem") == singularize(F.col("bare"))))
    guesses = hits.where(~own_key)
    if declared is not None:
        guesses = guesses.join(declared.select("source", "target").distinct(), ["source", "target"], "left_anti")
    best = F.min(F.struct((-F.col("c.m10")).alias("m"), "stem")).alias("b")
    pairs = guesses.groupBy("source", "target").agg(best).select("source", "target", (-F.col("b.m")).alias("m10"), F.col("b.stem").alias("stem"))
    match = F.when(F.col("m10") == 10, "exact").otherwise("fuzzy")
    told = F.concat(F.lit("Naming inference ("), match, F.lit("): "), "source", F.lit("."), "stem", F.lit("_id -> "), "target")
    return pairs.select("source", "target", F.expr(f"({BASE_C4[INFERRED_NAMING]} * m10) div 10").cast("long").alias("c4"), match.alias("match_type"), told.alias("evidence"))


def merge(declared: DataFrame, inferred: DataFrame, deduplicate: bool = False) -> DataFrame:
    """Both edge lists (source, target, type, c4) with `agreed`, whether the other one has the pair; optionally without the inferred that agree."""
    pairs = lambda e: e.select("source", "target").distinct().withColumn("agreed", F.lit(True))
    marked = lambda e, o: e.join(pairs(o), ["source", "target"], "left").withColumn("agreed", F.coalesce("agreed", F.lit(False)))
    guesses = marked(inferred, declared)
    return marked(declared, inferred).unionByName(guesses.where("not agreed") if deduplicate else guesses)


def merge_stats(declared: DataFrame, inferred: DataFrame) -> DataFrame:
    """One row: pairs in both, in one only, and the share of inferred pairs that are declared (in ten-thousandths)."""
    d, i = (e.select("source", "target").distinct() for e in (declared.withColumn("x", F.lit(1)), inferred))
    flags = d.withColumn("d", F.lit(1)).join(i.withColumn("i", F.lit(1)), ["source", "target"], "full_outer")
    count = lambda c: F.coalesce(F.sum(F.when(F.expr(c), 1)), F.lit(0)).cast("long")
    one = flags.agg(count("d = 1 and i = 1").alias("agreements"), count("d is null").alias("inferred_only"), count("i is null").alias("declared_only"))
    return one.withColumn("agreement_rate_c4", F.coalesce(F.expr("(agreements * 20000 + agreements + inferred_only) div nullif(2 * (agreements + inferred_only), 0)"), F.lit(0)).cast("long"))
