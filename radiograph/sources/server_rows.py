"""Catalog rows in the shape of a server's information schema and class tables, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def _name(prefix: str, *columns: Column) -> Column:
    return F.concat(F.lit(prefix), *[c.cast("string") for c in columns])


def tables(s: SparkSession, d: str) -> DataFrame:
    """A table for each part, in the schema of its type's first word; some are views, some the server's own."""
    schema = F.when(F.col("p_size") % 10 == 0, "pg_catalog").otherwise(F.lower(F.split("p_type", " ")[0]))
    kind = F.when(F.col("p_size") % 7 == 0, "VIEW").when(F.col("p_size") % 7 == 1, "MATERIALIZED VIEW").otherwise("BASE TABLE")
    return table(s, d, "part").select(schema.alias("table_schema"), _name("t", F.col("p_partkey")).alias("table_name"), kind.alias("table_type"))


def columns(s: SparkSession, d: str) -> DataFrame:
    """A column for each line of an order, of its part's table or, where an order has an even number, of a table that there isn't."""
    part = table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, "pg_catalog").otherwise(F.lower(F.split("p_type", " ")[0])).alias("table_schema"))
    lines = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").join(part, F.col("l_partkey") == F.col("p_partkey"))
    own = F.when(F.col("l_orderkey") % 2 == 0, "g").otherwise("t")
    return lines.select("table_schema", F.concat(own, F.col("l_partkey").cast("string")).alias("table_name"), _name("c", F.col("l_orderkey")).alias("column_name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal_position"), F.lower("l_linestatus").alias("data_type"), F.when(F.col("l_returnflag") == "A", "YES").otherwise("NO").alias("is_nullable"))


def _numbered_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("n")).distinct()


def constraints(s: SparkSession, d: str) -> DataFrame:
    """For each order a key of its customer's table, and what it refers to in the table of its status; key names repeat between schemas."""
    orders = table(s, d, "orders")
    name = _name("k", F.col("o_orderkey"))
    own = orders.select(name.alias("constraint_name"), F.when(F.col("o_custkey") % 17 == 0, "pg_toast").otherwise("sales").alias("table_schema"), _name("c", F.col("o_custkey")).alias("table_name"), F.lit("FOREIGN KEY").alias("constraint_type"))
    other = orders.select(name.alias("constraint_name"), F.lit("stock").alias("table_schema"), _name("s", F.lower("o_orderstatus")).alias("table_name"), F.lit("PRIMARY KEY").alias("constraint_type"))
    return own.unionByName(other)


def referential(s: SparkSession, d: str) -> DataFrame:
    schema = F.when(F.col("o_custkey") % 17 == 0, "pg_toast").otherwise("sales")
    return table(s, d, "orders").select(_name("k", F.col("o_orderkey")).alias("constraint_name"), schema.alias("constraint_schema"), _name("k", F.col("o_orderkey")).alias("unique_constraint_name"), F.lit("stock").alias("unique_constraint_schema"), F.lit("CASCADE").alias("update_rule"), F.col("o_orderpriority").alias("delete_rule"))


def key_columns(s: SparkSession, d: str) -> DataFrame:
    """A key has a column for each line number of its order; the unique one has them the other way round."""
    orders = table(s, d, "orders").join(_numbered_lines(s, d), F.col("o_orderkey") == F.col("l_orderkey"))
    schema, name = F.when(F.col("o_custkey") % 17 == 0, "pg_toast").otherwise("sales"), _name("k", F.col("o_orderkey")).alias("constraint_name")
    own = orders.select(name, schema.alias("constraint_schema"), schema.alias("table_schema"), _name("c", F.col("o_custkey")).alias("table_name"), _name("a", F.col("n")).alias("column_name"), F.col("n").alias("ordinal_position"), (F.lit(8) - F.col("n")).alias("position_in_unique_constraint"))
    other = orders.select(name, F.lit("stock").alias("constraint_schema"), F.lit("stock").alias("table_schema"), _name("s", F.lower("o_orderstatus")).alias("table_name"), _name("b", F.col("n")).alias("column_name"), (F.lit(8) - F.col("n")).alias("ordinal_position"), F.lit(None).cast("int").alias("position_in_unique_constraint"))
    return own.unionByName(other)


def classes(s: SparkSession, d: str) -> DataFrame:
    """A class for each region, nation, customer and order; regions and nations may be partitioned, customers may say that they are partitions."""
    row = lambda oid, prefix, key, kind, is_partition, space: (oid.cast("long").alias("oid"), _name(prefix, key).alias("relname"), kind.alias("relkind"), is_partition.alias("relispartition"), space.cast("long").alias("relnamespace"))
    split = lambda c: F.when(c, "p").otherwise("r")
    none = F.lit(None).cast("boolean")
    parts = [
        table(s, d, "region").select(*row(F.col("r_regionkey") + 1_000, "r", F.col("r_regionkey"), split(F.col("r_regionkey") % 2 == 0), none, F.lit(1))),
        table(s, d, "nation").select(*row(F.col("n_nationkey") + 2_000, "n", F.col("n_nationkey"), split(F.col("n_nationkey") % 3 == 0), none, F.lit(1))),
        table(s, d, "customer").select(*row(F.col("c_custkey") + 1_000_000_000, "c", F.col("c_custkey"), F.lit("r"), F.col("c_custkey") % 5 == 0, F.when(F.col("c_custkey") % 13 == 0, 3).otherwise(2))),
        table(s, d, "orders").select(*row(F.col("o_orderkey") + 2_000_000_000_000, "o", F.col("o_orderkey"), F.lit("r"), none, F.lit(2))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def namespaces(s: SparkSession, d: str) -> DataFrame:
    """A namespace for each of the first three regions: two of ours and one of the server's own."""
    return table(s, d, "region").where("r_regionkey between 0 and 2").select((F.col("r_regionkey") + 1).cast("long").alias("oid"), F.element_at(F.array(F.lit("geo"), F.lit("sales"), F.lit("pg_catalog")), (F.col("r_regionkey") + 1).cast("int")).alias("nspname"))


def inherits(s: SparkSession, d: str) -> DataFrame:
    """Nations inherit from their region, customers from their nation, orders from their customer: four levels."""
    link = lambda child, parent: (child.cast("long").alias("inhrelid"), parent.cast("long").alias("inhparent"))
    parts = [
        table(s, d, "nation").select(*link(F.col("n_nationkey") + 2_000, F.col("n_regionkey") + 1_000)),
        table(s, d, "customer").select(*link(F.col("c_custkey") + 1_000_000_000, F.col("c_nationkey") + 2_000)),
        table(s, d, "orders").select(*link(F.col("o_orderkey") + 2_000_000_000_000, F.col("o_custkey") + 1_000_000_000)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def class_tables(s: SparkSession, d: str) -> DataFrame:
    """The classes as tables; every eleventh customer is a view."""
    named = classes(s, d).join(namespaces(s, d).withColumnRenamed("oid", "relnamespace"), "relnamespace")
    return named.select(F.col("nspname").alias("table_schema"), F.col("relname").alias("table_name"), F.when(F.col("oid").between(1_000_000_000, 1_999_999_999_999) & (F.col("oid") % 11 == 0), "VIEW").otherwise("BASE TABLE").alias("table_type"))
