"""Unions, neighbourhoods, rankings and evaluations over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assembled(database: DataFrame, code: DataFrame) -> DataFrame:
    """(id, type, name, seq): the nodes of both; of nodes with one id the last wins (code after database) at the place of the first."""
    both = database.select("id", "type", "name", "seq", F.lit(0).alias("layer")).unionByName(code.select("id", "type", "name", "seq", F.lit(1).alias("layer")))
    last = F.max_by(F.struct("type", "name"), F.struct("layer", "seq", "type", "name")).alias("b")
    return both.groupBy("id").agg(last, F.min("seq").alias("seq")).select("id", "b.type", "b.name", "seq")


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def one_hop(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, type, c4): what points at roots(root) directly."""
    return edges.join(roots.select(F.col("root").alias("target")), "target").select(F.col("target").alias("root"), F.col("source").alias("node"), "type", "c4")


def neighbourhood(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): the distinct nodes one edge away from each root, in either direction."""
    both = edges.select(F.col("source").alias("root"), F.col("target").alias("node")).union(edges.select("target", "source"))
    return both.where("root <> node").join(roots.select("root"), "root", "left_semi").distinct()


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no edge to another node touches."""
    proper = edges.where("source <> target")
    touched = proper.select(F.col("source").alias("id")).union(proper.select("target")).distinct()
    return nodes.join(touched, "id", "left_anti")


def ranked(reached: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(root, type, place, node, c4, depth): a report's top rows per root and kind, by confidence, depth, name and id."""
    named = reached.join(nodes.select(F.col("id").alias("node"), "type", "name"), "node")
    order = Window.partitionBy("root", "type").orderBy(F.desc("c4"), "depth", "name", "node")
    return named.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most).select("root", "type", "place", "node", "c4", F.col("depth").cast("long").alias("depth"))


def evaluated(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Hits and misses per root of labels(root, node, expected BOOLEAN) against found(root, node), and over all of them.

    Nodes labelled False are negative controls; found nodes without a label don't count.
    """
    hits = found.select("root", "node").distinct().withColumn("hit", F.lit(True))
    rows = labels.join(hits, ["root", "node"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    count = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    sums = rows.rollup("root").agg(count("expected and hit").alias("tp"), count("expected and not hit").alias("fn"), count("not expected and hit").alias("fp"), count("not expected and not hit").alias("tn"))
    share = lambda a, b: F.coalesce(F.round(a / F.nullif(b, F.lit(0)), 4), F.lit(1.0))
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return sums.select(F.coalesce("root", F.lit("all")).alias("root"), "tp", "fn", "fp", "tn", share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"))


def merged_catalog(columns: DataFrame) -> DataFrame:
    """(table, column, type): of columns(rank, seq, table, column, type) the first definition of each column counts."""
    return columns.groupBy("table", "column").agg(F.min(F.struct("rank", "seq", "type")).alias("b")).select("table", "column", "b.type")


def lens_titles(touches: DataFrame, shown: int = 3) -> DataFrame:
    """(group, n, title): the distinct items of each group of touches(group, item); the title names the first few."""
    sets = touches.groupBy("group").agg(F.sort_array(F.collect_set("item")).alias("x"))
    more = F.when(F.size("x") > shown, F.concat(F.lit(" +"), (F.size("x") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return sets.select("group", F.size("x").cast("long").alias("n"), F.concat(F.array_join(F.slice("x", 1, shown), ", "), more).alias("title"))


def enclosing(lines: DataFrame, starts: Column) -> DataFrame:
    """lines(path, n, line) with block: the number of the last line up to it at which a block starts, else null."""
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.last(F.when(starts, F.col("n")), ignorenulls=True).over(before))


def touching(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, source, type): the edges that point at a table of tables(id, name), by its id, by its bare name or as one of `public`.

    Three equality joins instead of one with alternatives.
    """
    keys = [F.col("id"), F.concat(F.lit("table:"), F.lower("name")), F.concat(F.lit("table:public."), F.lower("name"))]
    asked = tables.select("id", F.explode(F.array_distinct(F.array(*keys))).alias("target"))
    return edges.select("source", "target", "type").join(asked, "target").select("id", "source", "type").distinct()


def most_common(rows: DataFrame, most: int) -> DataFrame:
    """(group, value, n, place) of rows(group, value, seq): each group's most common values, the first seen on a tie."""
    counts = rows.groupBy("group", "value").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "seq", "value"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("group", "value", "n", "place")
