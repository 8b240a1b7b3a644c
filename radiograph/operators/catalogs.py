"""A database server's catalog as tables, keys and hierarchies, from rows of its information schema and class tables.

The rows may come from a connection (`sources.server`) or any table of the same columns. Nothing is gathered but the
columns of one table or of one constraint, which a server bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..schema import BASE_C4, DECLARED_FK, STRUCTURAL

# Schemas of the server's own.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "pg_toast")


def of_schemas(rows: DataFrame, column: str, schemas: tuple[str, ...] | None = None) -> DataFrame:
    """rows whose schema isn't the server's own and, where schemas are given, is one of them."""
    rows = rows.where(~F.col(column).isin(*SYSTEM_SCHEMAS))
    return rows if schemas is None else rows.where(F.col(column).isin(*schemas))


def raw_catalog(tables: DataFrame, columns: DataFrame, schemas: tuple[str, ...] | None = None) -> DataFrame:
    """(full_name, schema, name, type, columns) of tables(table_schema, table_name, table_type) and columns(table_schema, table_name, column_name, ordinal_position, data_type, is_nullable).

    columns is an array by ordinal position; columns of unknown tables are left out, tables without any have none.
    """
    own = of_schemas(tables, "table_schema", schemas).select("table_schema", "table_name", "table_type").dropDuplicates(["table_schema", "table_name"])
    listed = of_schemas(columns, "table_schema", schemas).join(own.select("table_schema", "table_name"), ["table_schema", "table_name"], "left_semi")
    one = F.struct("ordinal_position", F.col("column_name").alias("name"), "data_type", (F.col("is_nullable") == "YES").alias("is_nullable"))
    held = listed.groupBy("table_schema", "table_name").agg(F.sort_array(F.collect_list(one)).alias("columns"))
    out = own.join(held, ["table_schema", "table_name"], "left")
    return out.select(F.concat_ws(".", "table_schema", "table_name").alias("full_name"), F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), F.col("table_type").alias("type"), F.coalesce("columns", F.array().cast(held.schema["columns"].dataType)).alias("columns"))


def declared_keys(constraints: DataFrame, referential: DataFrame, key_columns: DataFrame, schemas: tuple[str, ...] | None = None) -> DataFrame:
    """One edge for each foreign key, however many columns it has: source, target, type, c4, evidence, constraint_name, source_columns, target_columns, update_rule, delete_rule.

    A key's columns meet those of the unique constraint that it refers to by position, which need not be their order; both
    lists are in the order of the key's own columns. constraints(constraint_name, table_schema, table_name,
    constraint_type), referential(constraint_name, constraint_schema, unique_constraint_name, unique_constraint_schema,
    update_rule, delete_rule), key_columns(constraint_name, constraint_schema, table_schema, table_name, column_name,
    ordinal_position, position_in_unique_constraint).
    """
    keys = of_schemas(constraints.where("constraint_type = 'FOREIGN KEY'"), "table_schema", schemas).select("constraint_name", F.col("table_schema").alias("source_schema"), F.col("table_name").alias("source_table"))
    rules = referential.select("constraint_name", F.col("constraint_schema").alias("source_schema"), "unique_constraint_name", "unique_constraint_schema", "update_rule", "delete_rule")
    own = key_columns.select("constraint_name", F.col("table_schema").alias("source_schema"), F.col("column_name").alias("own"), "ordinal_position", F.col("position_in_unique_constraint").alias("position"))
    theirs = key_columns.select(F.col("constraint_name").alias("unique_constraint_name"), F.col("constraint_schema").alias("unique_constraint_schema"), F.col("ordinal_position").alias("position"), F.col("table_schema").alias("target_schema"), F.col("table_name").alias("target_table"), F.col("column_name").alias("theirs"))
    pairs = keys.join(rules, ["constraint_name", "source_schema"]).join(own, ["constraint_name", "source_schema"]).join(theirs, ["unique_constraint_name", "unique_constraint_schema", "position"])
    group = ["source_schema", "source_table", "constraint_name", "target_schema", "target_table"]
    held = pairs.groupBy(*group).agg(F.sort_array(F.collect_set(F.struct("ordinal_position", "own", "theirs"))).alias("x"), F.min("update_rule").alias("update_rule"), F.min("delete_rule").alias("delete_rule"))
    side = lambda c: F.transform("x", lambda p: p[c])
    source, target = F.concat_ws(".", "source_schema", "source_table"), F.concat_ws(".", "target_schema", "target_table")
    evidence = F.concat(F.lit("FK "), "constraint_name", F.lit(": "), source, F.lit("("), F.array_join(side("own"), ", "), F.lit(") -> "), target, F.lit("("), F.array_join(side("theirs"), ", "), F.lit(")"))
    return held.select(
        F.concat(F.lit("table:"), source).alias("source"), F.concat(F.lit("table:"), target).alias("target"), F.lit(DECLARED_FK).alias("type"), F.lit(BASE_C4[DECLARED_FK]).cast("long").alias("c4"), evidence.alias("evidence"),
        "constraint_name", side("own").alias("source_columns"), side("theirs").alias("target_columns"), "update_rule", "delete_rule",
    )


def inheritance(inherits: DataFrame, classes: DataFrame, namespaces: DataFrame, schemas: tuple[str, ...] | None = None) -> DataFrame:
    """(child, parent, is_partition) of inherits(inhrelid, inhparent), classes(oid, relname, relkind, relispartition, relnamespace), namespaces(oid, nspname).

    A child is a partition if it says so or its parent is partitioned (relkind p).
    """
    named = classes.join(namespaces.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace")
    full = F.concat_ws(".", "nspname", "relname")
    child = of_schemas(named, "nspname", schemas).select(F.col("oid").alias("inhrelid"), full.alias("child"), F.coalesce("relispartition", F.lit(False)).alias("own"))
    parent = named.select(F.col("oid").alias("inhparent"), full.alias("parent"), (F.col("relkind") == "p").alias("partitioned"))
    return inherits.join(child, "inhrelid").join(parent, "inhparent").select("child", "parent", (F.col("own") | F.col("partitioned")).alias("is_partition")).distinct()


def partitioned(classes: DataFrame, namespaces: DataFrame, schemas: tuple[str, ...] | None = None) -> DataFrame:
    """(parent): tables that are partitioned, also those without partitions yet."""
    named = classes.where("relkind = 'p'").join(namespaces.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace")
    return of_schemas(named, "nspname", schemas).select(F.concat_ws(".", "nspname", "relname").alias("parent")).distinct()


def ancestry(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(child, ancestor, distance, is_partition): the closure of links(child, parent, is_partition), by the shortest way.

    is_partition tells whether any link on that way is one of a partition. Each round doubles the distance that is
    covered: ways of up to d links meet ways of up to d links. Circles end where nothing new is found.
    """
    held = cut(links.where("child <> parent").groupBy("child", F.col("parent").alias("ancestor")).agg(F.lit(1).alias("distance"), F.max("is_partition").alias("is_partition")))
    reached = held.count()
    for _ in range(most_rounds):
        further = held.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"), F.col("is_partition").alias("later"))
        longer = held.join(further, "ancestor").where("child <> next").select("child", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"), (F.col("is_partition") | F.col("later")).alias("is_partition"))
        best = F.min(F.struct("distance", (~F.col("is_partition")).alias("plain"))).alias("b")
        held = cut(held.unionByName(longer).groupBy("child", "ancestor").agg(best).select("child", "ancestor", "b.distance", (~F.col("b.plain")).alias("is_partition")))
        now = held.count()
        if now == reached:
            return held
        reached = now
    raise RuntimeError(f"the hierarchy has no end within 2^{most_rounds} links")


def server_nodes(catalog: DataFrame, links: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, type, name, source_system, parent, root, levels, is_partitioned) of a raw catalog, its inheritance links and partitioned tables.

    A view is a view, a table below a partition link at any level a partition, others are tables. root is the farthest
    ancestor and levels how far it is; parent is the nearest.
    """
    closure = ancestry(links)
    nearest, farthest = F.min(F.struct("distance", "ancestor")).alias("near"), F.max(F.struct("distance", "ancestor")).alias("far")
    above = closure.groupBy(F.col("child").alias("full_name")).agg(nearest, farthest, F.max("is_partition").alias("below"))
    rows = catalog.select("full_name", "name", "type").join(above, "full_name", "left").join(parents.select(F.col("parent").alias("full_name"), F.lit(True).alias("splits")), "full_name", "left")
    kind = F.when(F.col("type").contains("VIEW"), "view").when(F.coalesce("below", F.lit(False)), "partition").otherwise("table")
    return rows.select(
        F.concat(F.lit("table:"), "full_name").alias("id"), kind.alias("type"), "name", F.lit("postgres").alias("source_system"), F.col("near.ancestor").alias("parent"), F.col("far.ancestor").alias("root"),
        F.coalesce("far.distance", F.lit(0)).cast("long").alias("levels"), F.coalesce("splits", F.lit(False)).alias("is_partitioned"),
    )


def structural_edges(links: DataFrame) -> DataFrame:
    """(source, target, type, c4, evidence, relationship): an edge from each child to its parent."""
    table = lambda c: F.concat(F.lit("table:"), c)
    label = lambda a, b: F.when(F.col("is_partition"), a).otherwise(b)
    return links.select(table("child").alias("source"), table("parent").alias("target"), F.lit(STRUCTURAL).alias("type"), F.lit(BASE_C4[STRUCTURAL]).cast("long").alias("c4"), F.concat(label("Partition of ", "Inherits from "), "parent").alias("evidence"), label("partition", "inheritance").alias("relationship"))


def merged_keys(keys: DataFrame) -> DataFrame:
    """(table, column, target, target_column) of keys(rank, seq, table, column, target, target_column): of definitions in several sources a table's keys to a target come from the first that has any."""
    first = keys.groupBy("table", "target").agg(F.min("rank").alias("rank"))
    return keys.join(first, ["table", "target", "rank"], "left_semi").groupBy("table", "column", "target").agg(F.min(F.struct("seq", "target_column")).alias("b")).select("table", "column", "target", "b.target_column")
