"""The row-level graph, catalog and other inputs that queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import UNRESOLVED_ID, UNRESOLVED_NAME

KIND = 10**15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *keys: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each row of seven tables, and for each brand and the unresolved sink."""
    of = lambda n, kind, seq, node, name, key: table(spark, sf_dir, n).select(
        (F.lit(seq * KIND) + key).cast("long").alias("seq"), node.alias("id"), F.lit(kind).alias("type"), name.alias("name"), F.lit("postgres").alias("source_system")
    )
    parts = [
        of("region", "table", 0, _id("region", "r_regionkey"), F.col("r_name"), F.col("r_regionkey")),
        of("nation", "table", 1, _id("nation", "n_nationkey"), F.col("n_name"), F.col("n_nationkey")),
        of("customer", "table", 2, _id("customer", "c_custkey"), F.col("c_name"), F.col("c_custkey")),
        of("supplier", "view", 3, _id("supplier", "s_suppkey"), F.col("s_name"), F.col("s_suppkey")),
        of("part", "table", 4, _id("part", "p_partkey"), F.col("p_name"), F.col("p_partkey")),
        of("orders", "function", 5, _id("orders", "o_orderkey"), _id("order", "o_orderkey"), F.col("o_orderkey")),
        of("lineitem", "file", 6, _id("lineitem", "l_orderkey", "l_linenumber"), _id("line", "l_orderkey", "l_linenumber"), F.col("l_orderkey") * 100 + F.col("l_linenumber")).distinct(),
        table(spark, sf_dir, "part").select(F.lit(7 * KIND).alias("seq"), F.concat(F.lit("brand:"), "p_brand").alias("id"), F.lit("partition").alias("type"), F.col("p_brand").alias("name"), F.lit("postgres").alias("source_system")).distinct(),
        spark.range(1).select(F.lit(8 * KIND).alias("seq"), F.lit(UNRESOLVED_ID).alias("id"), F.lit("table").alias("type"), F.lit(UNRESOLVED_NAME).alias("name"), F.lit("postgres").alias("source_system")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows' references as typed edges; the types and weights are an assignment of ours."""
    of = lambda n, kind, c4, seq, source, target, key: table(spark, sf_dir, n).select(
        (F.lit(seq * KIND) + key).cast("long").alias("seq"), source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(c4).cast("long").alias("c4")
    )
    line, line_key = _id("lineitem", "l_orderkey", "l_linenumber"), F.col("l_orderkey") * 100 + F.col("l_linenumber")
    parts = [
        of("nation", "declared_fk", 10000, 0, _id("nation", "n_nationkey"), _id("region", "n_regionkey"), F.col("n_nationkey")),
        of("customer", "declared_fk", 10000, 1, _id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.col("c_custkey")),
        of("supplier", "inferred_naming", 9200, 2, _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.col("s_suppkey")),
        of("orders", "orm_call", 9800, 3, _id("orders", "o_orderkey"), _id("customer", "o_custkey"), F.col("o_orderkey")),
        of("lineitem", "declared_fk", 10000, 4, line, _id("orders", "l_orderkey"), line_key),
        of("lineitem", "static_sql_string", 9600, 5, line, _id("part", "l_partkey"), line_key),
        of("lineitem", "inferred_naming", 8280, 6, line, _id("supplier", "l_suppkey"), line_key),
        of("part", "structural_belongs_to", 10000, 7, _id("part", "p_partkey"), F.concat(F.lit("brand:"), "p_brand"), F.col("p_partkey")),
        table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.lit(8 * KIND) + F.col("o_orderkey")).cast("long").alias("seq"), _id("orders", "o_orderkey").alias("source"), F.lit(UNRESOLVED_ID).alias("target"), F.lit("dynamic_unresolved").alias("type"), F.lit(1500).cast("long").alias("c4")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GRAPH_SQL = """
nodes as (
  select r_regionkey::bigint as seq, 'region:' || r_regionkey as id, 'table' as type, r_name as name from region
  union all select 1000000000000000 + n_nationkey, 'nation:' || n_nationkey, 'table', n_name from nation
  union all select 2000000000000000 + c_custkey, 'customer:' || c_custkey, 'table', c_name from customer
  union all select 3000000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'view', s_name from supplier
  union all select 4000000000000000 + p_partkey, 'part:' || p_partkey, 'table', p_name from part
  union all select 5000000000000000 + o_orderkey, 'orders:' || o_orderkey, 'function', 'order:' || o_orderkey from orders
  union all select distinct 6000000000000000 + l_orderkey * 100 + l_linenumber, 'lineitem:' || l_orderkey || '.' || l_linenumber, 'file', 'line:' || l_orderkey || '.' || l_linenumber from lineitem
  union all select distinct 7000000000000000, 'brand:' || p_brand, 'partition', p_brand from part
  union all select 8000000000000000, 'table:unresolved', 'table', '<unresolved_dynamic_query>'
), edges as (
  select n_nationkey::bigint as seq, 'nation:' || n_nationkey as source, 'region:' || n_regionkey as target, 'declared_fk' as type, 10000::bigint as c4 from nation
  union all select 1000000000000000 + c_custkey, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'declared_fk', 10000 from customer
  union all select 2000000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'inferred_naming', 9200 from supplier
  union all select 3000000000000000 + o_orderkey, 'orders:' || o_orderkey, 'customer:' || o_custkey, 'orm_call', 9800 from orders
  union all select 4000000000000000 + l_orderkey * 100 + l_linenumber, 'lineitem:' || l_orderkey || '.' || l_linenumber, 'orders:' || l_orderkey, 'declared_fk', 10000 from lineitem
  union all select 5000000000000000 + l_orderkey * 100 + l_linenumber, 'lineitem:' || l_orderkey || '.' || l_linenumber, 'part:' || l_partkey, 'static_sql_string', 9600 from lineitem
  union all select 6000000000000000 + l_orderkey * 100 + l_linenumber, 'lineitem:' || l_orderkey || '.' || l_linenumber, 'supplier:' || l_suppkey, 'inferred_naming', 8280 from lineitem
  union all select 7000000000000000 + p_partkey, 'part:' || p_partkey, 'brand:' || p_brand, 'structural_belongs_to', 10000 from part
  union all select 8000000000000000 + o_orderkey, 'orders:' || o_orderkey, 'table:unresolved', 'dynamic_unresolved', 1500 from orders where o_orderstatus = 'P'
), ends as (
  select case when type = 'structural_belongs_to' then source else target end as u, case when type = 'structural_belongs_to' then target else source end as v, c4, type, seq from edges
), prop as (
  select u, v, first(c4 order by c4 desc, seq) as c4, first(type order by c4 desc, seq) as type, min(seq) as seq from ends group by u, v
)
"""


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tables, columns): a table for each part name of a part type; it has a key column for each part ordered with it."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("schema"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("name"))
    named = part.withColumn("full_name", F.concat_ws(".", "schema", "name"))
    tables = named.select("full_name", "schema", "name").distinct().withColumn("seq", F.length("full_name").cast("long"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    here, there = lines.join(named, F.col("l_partkey") == F.col("p_partkey")), lines.join(named, F.col("l_partkey") == F.col("p_partkey"))
    a = here.select("l_orderkey", F.col("l_linenumber").alias("n"), "full_name")
    b = there.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.concat("name", F.lit("_id")).alias("column"))
    return tables, a.join(b, ["l_orderkey", "n"]).select("full_name", "column").distinct()
