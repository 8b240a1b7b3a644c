"""From changed files to affected tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import bare_name, normal_path, path_suffixes
from ..plans.lineage import cut, small
from ..schema import STRUCTURAL, UNRESOLVED_NAME
from .graph import blast_radius, propagation, resolve_targets


def suffix_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_path, right_path): paths of which one ends with the other, at a '/' boundary.

    Two equality joins over all suffixes instead of a comparison of every pair.
    """
    a = left.select(normal_path(F.col("path")).alias("left_path")).where("left_path <> ''").distinct()
    b = right.select(normal_path(F.col("path")).alias("right_path")).where("right_path <> ''").distinct()
    one = a.withColumn("k", F.explode(path_suffixes(F.col("left_path")))).join(b, F.col("k") == F.col("right_path"))
    two = b.withColumn("k", F.explode(path_suffixes(F.col("right_path")))).join(a, F.col("k") == F.col("left_path"))
    return one.select("left_path", "right_path").union(two.select("left_path", "right_path")).distinct()


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name): names(name) that stand in texts(id, text) between characters that are neither letters nor digits.

    Runs of letters and digits are joined: a name of several runs (`order_items`) with as many consecutive runs of a text,
    after which what stands between them is compared. Case doesn't count; names without letters or digits match nothing.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    wanted = names.select(F.lower("name").alias("name")).distinct().withColumn("runs", split(F.col("name"))).where(F.size("runs") > 0)
    wanted = cut(wanted.select("name", F.array_join("runs", " ").alias("k"), F.size("runs").alias("n")))
    lengths = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # one for each number of runs that a name has
    if not lengths:
        return texts.select("id", F.lit("").alias("name")).limit(0)
    held = texts.select("id", F.lower("text").alias("text")).withColumn("runs", split(F.col("text")))
    stretches = lambda n: F.when(F.size("runs") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("runs") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("runs", i, n), " ")))
    keys = held.select("id", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*map(stretches, lengths)))))).alias("k"))
    hits = keys.join(small(wanted), "k")
    # A name that is one run is proved by being one; of others, what stands between and around the runs has to be the same.
    is_run = (F.col("n") == 1) & (F.col("name") == F.col("k"))
    plain = hits.where(is_run).select("id", "name")
    apart = hits.where(~is_run).select("id", "name").distinct()
    inside = lambda t, name: F.regexp_like(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), name, F.lit(r"\E(?![a-z0-9])")))
    proved = apart.join(held.select("id", "text"), "id").where(inside(F.col("text"), F.col("name"))).select("id", "name")
    return plain.union(proved).distinct()


def affected_tables(changed: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(name): the tables that changed(path) files affect, of nodes(id, type, name, file), in four ways.

    Functions of a changed file (by their file, the file in their id, or an edge to it) affect what they point at, by id
    or else by the name after the last dot; changed .sql files affect the tables named in their path or, where texts(path,
    content) has them, in their content; a table that comes from a changed file is affected itself.
    """
    tables = nodes.where(F.col("type").isin("table", "view") & (F.col("name") != UNRESOLVED_NAME)).select("id", "name", "file")
    parts = F.split("id", ":")
    own = nodes.where("type = 'function'").select("id", F.explode(F.array_compact(F.array("file", F.when(F.size(parts) >= 3, F.get(parts, 1))))).alias("file"))
    belongs = edges.where(F.col("type") == STRUCTURAL).select(F.col("source").alias("id"), F.replace("target", F.lit("file:"), F.lit("")).alias("file"))
    placed = own.withColumn("code", F.lit(True)).union(belongs.withColumn("code", F.lit(True))).unionByName(tables.where("file is not null").select("id", "file", F.lit(False).alias("code")))
    hit = suffix_matches(placed.select(F.col("file").alias("path")), changed).select(F.col("left_path").alias("f")).distinct()
    moved = placed.withColumn("f", normal_path(F.col("file"))).join(hit, "f", "left_semi").select("id", "code").distinct()
    reached = edges.join(moved.where("code").select(F.col("id").alias("source")), "source", "left_semi").select("target").distinct()
    by_id = reached.join(tables.select(F.col("id").alias("target"), "name"), "target", "left")
    bare = by_id.where(F.col("name").isNull() & F.col("target").startswith("table:")).select(bare_name(F.col("target")).alias("name"))
    by_name = bare.join(tables.select("name").distinct(), "name", "left_semi")
    direct = tables.join(moved.where("not code"), "id", "left_semi").select("name")
    scripts = changed.where(F.col("path").endswith(".sql")).select("path").distinct()
    read = scripts.select("path", F.col("path").alias("text"))
    if texts is not None:
        read = read.union(texts.join(scripts, "path", "left_semi").select("path", F.col("content").alias("text")))
    numbered = cut(read.withColumn("id", F.monotonically_increasing_id()))
    told = mentions(numbered.select("id", "text"), tables.select("name")).select(F.col("name").alias("key"))
    in_sql = tables.join(told, F.lower("name") == F.col("key"), "left_semi").select("name")
    return by_id.where("name is not null").select("name").union(by_name).union(in_sql).union(direct).distinct()


def change_impact(changed: DataFrame, nodes: DataFrame, edges: DataFrame, texts: DataFrame | None = None, max_depth: int = 2, least_c4: int = 0, high: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tables, summary) of changed(path) files: each affected table's blast radius, found again by its name, and all together.

    tables: name, root, total, functions, files, tables, deepest, high_risk; a table whose name finds no node has none of
    them. summary: changed_files, affected_tables, impacted, largest, high_risk (how many; the first result names them).
    """
    affected = cut(affected_tables(changed, nodes, edges, texts))
    roots = cut(resolve_targets(nodes, affected.select(F.col("name").alias("target"))).select(F.col("target").alias("name"), F.col("id").alias("root")))
    reached = blast_radius(propagation(edges), roots.where("root is not null").select("root").distinct(), max_depth, least_c4)
    each = impact_summary(reached, nodes, high)
    tables = roots.join(each, "root", "left").select("name", "root", F.coalesce("total", F.lit(0)).alias("total"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("functions", "files", "tables", "deepest")], F.coalesce("high_risk", F.lit(high <= 0)).alias("high_risk"))
    tables = cut(tables)
    one = tables.agg(F.count("*").alias("affected_tables"), F.coalesce(F.sum("total"), F.lit(0)).alias("impacted"), F.coalesce(F.max("total"), F.lit(0)).alias("largest"), F.coalesce(F.sum(F.col("high_risk").cast("long")), F.lit(0)).alias("high_risk"))
    return tables, changed.agg(F.count("*").alias("changed_files")).crossJoin(one)


def impact_summary(reached: DataFrame, nodes: DataFrame, high: int = 5) -> DataFrame:
    """Per root of a blast radius: impacted nodes by kind, deepest hop, and whether it is high risk."""
    reached = reached.select("root", "node", "depth")
    count = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("long")
    every = reached.groupBy("root").agg(F.count("*").alias("total"), F.max("depth").cast("long").alias("deepest"))
    known = reached.join(nodes.select(F.col("id").alias("node"), "type"), "node")  # the smaller side is found at run time
    kinds = known.groupBy("root").agg(count("type = 'function'").alias("functions"), count("type = 'file'").alias("files"), count("type in ('table', 'view', 'partition')").alias("tables"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(kinds, "root", "left").select("root", "total", none("functions"), none("files"), none("tables"), "deepest")
    return out.withColumn("high_risk", F.col("total") >= high)
