"""Queries over catalogs of database servers and schema texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogs, schemas
from ..sources import server_rows as rows
from ..sources.code import schema_files


def _catalog(s: SparkSession, d: str) -> DataFrame:
    held = catalogs.raw_catalog(rows.tables(s, d), rows.columns(s, d))
    shown = F.transform("columns", lambda c: F.concat(c["name"], F.lit(" "), c["data_type"], F.when(c["is_nullable"], "").otherwise(" not null")))
    return held.select("full_name", "type", F.size("columns").cast("long").alias("n_columns"), F.array_join(shown, ", ").alias("columns"))


def _keys(s: SparkSession, d: str) -> DataFrame:
    held = catalogs.declared_keys(rows.constraints(s, d), rows.referential(s, d), rows.key_columns(s, d))
    return held.select("source", "target", "type", "c4", "evidence", "constraint_name", F.array_join("source_columns", ",").alias("source_columns"), F.array_join("target_columns", ",").alias("target_columns"), "update_rule", "delete_rule")


def _links(s: SparkSession, d: str) -> DataFrame:
    return catalogs.inheritance(rows.inherits(s, d), rows.classes(s, d), rows.namespaces(s, d))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    listed = rows.class_tables(s, d)
    catalog = catalogs.raw_catalog(listed, rows.columns(s, d))
    return catalogs.server_nodes(catalog, _links(s, d), catalogs.partitioned(rows.classes(s, d), rows.namespaces(s, d)))


def _merged_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys of three sources: what an order's number leaves by three; a customer's table refers to those of the priorities."""
    keys = rows.table(s, d, "orders").select((F.col("o_orderkey") % 3).alias("rank"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("table"), F.concat(F.lit("c"), (F.col("o_orderkey") % 7).cast("string")).alias("column"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("target_column"))
    return catalogs.merged_keys(keys)


def _constraints(s: SparkSession, d: str) -> DataFrame:
    held = schemas.ddl_constraints(schema_files(s, d, "full"))
    return held.select("path", "table", "constraint", F.array_join("columns", ",").alias("columns"), "target", F.array_join("target_columns", ",").alias("target_columns"))


def queries() -> dict:
    return {
        "server_catalog": _catalog,
        "server_keys": _keys,
        "server_nodes": _nodes,
        "server_structure": lambda s, d: catalogs.structural_edges(_links(s, d)),
        "catalog_merge_keys": _merged_keys,
        "ddl_objects": lambda s, d: schemas.ddl_objects(schema_files(s, d, "full")),
        "ddl_constraints": _constraints,
        "ddl_nested_columns": lambda s, d: schemas.ddl(schema_files(s, d, "full"))[0],
    }


_PART_SCHEMA = "case when p_size % 10 = 0 then 'pg_catalog' else lower(string_split(p_type, ' ')[1]) end"
_HIERARCHY = """named as (
  select 'geo.r' || r_regionkey as n, 'r' || r_regionkey as bare, null as parent, false as link_p, r_regionkey % 2 = 0 as splits, false as is_view from region
  union all select 'geo.n' || n_nationkey, 'n' || n_nationkey, 'geo.r' || n_regionkey, n_regionkey % 2 = 0, n_nationkey % 3 = 0, false from nation
  union all select case when c_custkey % 13 = 0 then 'pg_catalog.c' else 'sales.c' end || c_custkey, 'c' || c_custkey, 'geo.n' || c_nationkey, c_custkey % 5 = 0 or c_nationkey % 3 = 0, false, (c_custkey + 1000000000) % 11 = 0 from customer
  union all select 'sales.o' || o_orderkey, 'o' || o_orderkey, case when o_custkey % 13 = 0 then 'pg_catalog.c' else 'sales.c' end || o_custkey, false, false, false from orders
), own as (select * from named where not starts_with(n, 'pg_catalog.')),
links as (select n as child, parent, link_p from own where parent is not null)"""
_ORDER = "(select o_custkey as c, o_orderkey::varchar as o, lag(o_orderkey::varchar) over (partition by o_custkey order by o_orderkey) as p from orders)"
SQL = {
    "server_catalog": f"""with t as (select p_partkey as k, {_PART_SCHEMA} as s, case p_size % 7 when 0 then 'VIEW' when 1 then 'MATERIALIZED VIEW' else 'BASE TABLE' end as type from part),
      c as (select l_partkey as k, count(*) as n, string_agg('c' || l_orderkey || ' ' || lower(l_linestatus) || case when l_returnflag = 'A' then '' else ' not null' end, ', '
          order by l_orderkey * 10 + l_linenumber, 'c' || l_orderkey, lower(l_linestatus), l_returnflag = 'A') as cols from lineitem where l_orderkey % 2 <> 0 group by 1)
      select s || '.t' || t.k as full_name, type, coalesce(n, 0) as n_columns, coalesce(cols, '') as columns from t left join c using (k) where s <> 'pg_catalog'""",
    "server_keys": """with l as (select distinct l_orderkey as o, l_linenumber as n from lineitem), k as (select o, string_agg('a' || n, ',' order by n) as a, string_agg('b' || n, ',' order by n) as b from l group by o)
      select 'table:sales.c' || o_custkey as source, 'table:stock.s' || lower(o_orderstatus) as target, 'declared_fk' as type, 10000::bigint as c4,
        'FK k' || o_orderkey || ': sales.c' || o_custkey || '(' || replace(a, ',', ', ') || ') -> stock.s' || lower(o_orderstatus) || '(' || replace(b, ',', ', ') || ')' as evidence,
        'k' || o_orderkey as constraint_name, a as source_columns, b as target_columns, 'CASCADE' as update_rule, o_orderpriority as delete_rule from orders join k on o = o_orderkey where o_custkey % 17 <> 0""",
    "server_nodes": f"""with recursive {_HIERARCHY}, up as (select child, parent as ancestor, 1 as d, link_p as p from links union all select u.child, l.parent, d + 1, p or l.link_p from up u join links l on l.child = u.ancestor),
      a as (select child, first(ancestor order by d) as near, first(ancestor order by d desc) as far, max(d) as levels, bool_or(p) as below from up group by child)
      select 'table:' || n as id, case when is_view then 'view' when coalesce(below, false) then 'partition' else 'table' end as type, bare as name, 'postgres' as source_system, near as parent, far as root, coalesce(levels, 0)::bigint as levels, splits as is_partitioned
      from own left join a on child = n""",
    "server_structure": f"""with {_HIERARCHY} select 'table:' || child as source, 'table:' || parent as target, 'structural_belongs_to' as type, 10000::bigint as c4,
      case when link_p then 'Partition of ' else 'Inherits from ' end || parent as evidence, case when link_p then 'partition' else 'inheritance' end as relationship from links""",
    "catalog_merge_keys": """with k as (select o_orderkey % 3 as r, o_orderkey as seq, o_custkey % 50 as t, 'c' || o_orderkey % 7 as c, o_orderpriority as g, o_orderstatus as tc from orders), f as (select t, g, min(r) as r from k group by t, g)
      select t as "table", c as "column", g as target, first(tc order by seq, tc) as target_column from k join f using (t, g, r) group by t, c, g""",
    "ddl_objects": f"""select 'schema/c' || c || '.sql' as path, unnest([{{'n': 'orders_' || o, 'k': 'table', 'p': null}}, {{'n': 'orders_' || o || '_y', 'k': 'partition', 'p': 'orders_' || o}}, {{'n': 'v_' || o, 'k': 'view', 'p': null}}]) as x from {_ORDER}""",
    "ddl_constraints": f"""select 'schema/c' || c || '.sql' as path, 'orders_' || o as "table", 'fk_orders_' || o || '_prev_id' as "constraint", 'prev_id' as columns, 'orders_' || p as target, 'id' as target_columns from {_ORDER} where p is not null
      union all select 'schema/c' || c || '.sql', 'orders_' || o, 'pair_' || o, 'id,cust_id', 'pairs', 'a,b' from {_ORDER} union all select 'schema/c' || c || '.sql', 'orders_' || o, 'fk_orders_' || o || '_customers', 'cust_id', 'customers', 'id' from {_ORDER}
      union all select 'schema/c' || c || '.sql', 'orders_' || o, 'self_' || o, 'deep', 'orders_' || o, 'id' from {_ORDER}""",
    "ddl_nested_columns": f"""with x as (select c, o, p, unnest([{{'n': 'id', 't': 'integer', 'k': true, 'z': false, 'w': true}}, {{'n': 'deep', 't': 'numeric(10, 2)', 'k': false, 'z': true, 'w': true}}, {{'n': 'note', 't': 'varchar(20)', 'k': false, 'z': true, 'w': true}},
        {{'n': 'cust_id', 't': 'integer', 'k': false, 'z': false, 'w': true}}, {{'n': 'prev_id', 't': 'integer', 'k': false, 'z': true, 'w': p is not null}}]) as f from {_ORDER})
      select 'schema/c' || c || '.sql' as path, 'orders_' || o as "table", f.n as "column", f.t as type, f.k as primary_key, f.z as nullable from x where f.w""",
}
SQL["ddl_objects"] = f"select path, x.n as name, x.k as kind, x.p as parent from ({SQL['ddl_objects']})"
