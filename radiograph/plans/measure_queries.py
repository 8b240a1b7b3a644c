"""Queries that sample, pair, number and report, and a graph kept up to date from a stream, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import changes, clusters, graph, paths, reports, statistics
from ..sources.tables import GRAPH_SQL, edges, nodes, table
from ..streaming import maintained
from .lineage import cut, shared_folder, union
from .numbering import numbered, zipped
from .sql import EVIDENCE, TIER

HOPS = {"1": 150, "2": 200, "3": 200}


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """The row-level graph's edges, each true or not by its number, true ones the more frequent the more confident they are."""
    return edges(s, d).select("source", "target", "c4", (F.col("seq") % 10007 * 7919 % 10000 < F.col("c4")).alias("actual"))


def _sample(s: SparkSession, d: str) -> DataFrame:
    return paths.path_sample(_labelled(s, d), HOPS)


def _zipped(s: SparkSession, d: str) -> DataFrame:
    """Predictions of the labelled documents in one list, their labels in another, both by document."""
    labels = table(s, d, "labels")
    predicted = table(s, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", (F.expr("n_chars % 997") / F.lit(997.0)).alias("p"))
    pairs = zipped(predicted.withColumnRenamed("doc_id", "a"), labels.select(F.col("doc_id").alias("b"), F.col("quality").cast("long").alias("actual")), "a", "b")
    return pairs.select("place", "p", "actual")


def _maintained(s: SparkSession, d: str) -> str:
    """Replay the events in four files: each is a new version of its user's file, which refers to tables or, for an error, is deleted."""
    folder = f"{shared_folder(s).rstrip('/')}/replay-{uuid.uuid4().hex}"
    content = F.when(F.col("event_type") != "error", F.concat(F.lit("select 1 from "), "event_type", F.lit(" join t"), (F.col("event_id") % 5).cast("string"), F.lit(" join t"), (F.col("event_id") % 3).cast("string")))
    files = table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), content.alias("content"), F.col("ts").cast("timestamp").alias("changed"))
    files.repartitionByRange(4, "changed").write.parquet(f"{folder}/in")
    stream = s.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    maintained.maintain(stream, names.sql_tables, folder).awaitTermination()
    return folder


def _nation_roots(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    roots = _nation_roots(s, d)
    parts = graph.reached_parts(edges(s, d), roots, 3)
    tops = union(cut(reports.top_rows(reached, nodes(s, d).where(mine("id")), verbose=True)) for reached, mine in parts)
    return reports.written_reports(roots, tops, nodes(s, d), cut(graph.blind_spots(nodes(s, d), edges(s, d))))


def _change_report(s: SparkSession, d: str) -> DataFrame:
    """All pages' paths have changed, and every supplier is affected."""
    changed = table(s, d, "pages").select(F.regexp_replace("url", "^[a-z]+://[^/]+", ".").alias("path"))
    roots = table(s, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("root"))
    reached = cut(graph.blast_radius(graph.propagation(edges(s, d)), roots.select("root"), 1))
    each = roots.join(changes.impact_summary(reached, nodes(s, d)), "root", "left").select("name", "root", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("high_risk", F.lit(False)).alias("high_risk"))
    return reports.change_report(changed, cut(each), reached, nodes(s, d), graph.blind_spots(nodes(s, d), edges(s, d)))


def _second(s: SparkSession, d: str) -> DataFrame:
    """Orders aren't among the nodes, so they are told by the edges."""
    known = nodes(s, d).where("type <> 'function' and type <> 'view'")
    parts = graph.reached_parts(edges(s, d), _nation_roots(s, d), 2)
    return union(cut(graph.named_ends(cut(reached.select("root", "node", "c4", "depth")), known, edges(s, d), mine)) for reached, mine in parts)


def module_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a table for each part type and kind of thing; lines that follow each other are keys, orders touch their lines' tables."""
    part = table(s, d, "part").select("p_partkey", F.concat(F.lit("table:shop."), F.lower("p_type"), F.lit("_"), F.split("p_name", " ")[1]).alias("id"))
    lines = table(s, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "id")
    code = lines.select(F.concat(F.lit("func:o"), F.col("l_orderkey").cast("string")).alias("source"), F.col("id").alias("target"), F.lit(9600).cast("long").alias("c4")).distinct()
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("id").alias("target"))
    keys = lines.withColumnRenamed("id", "source").join(after, ["l_orderkey", "l_linenumber"]).select("source", "target", F.lit(10000).cast("long").alias("c4")).distinct()
    return part.select("id", F.lit("table").alias("type")).distinct(), keys.union(code)


def _described(s: SparkSession, d: str) -> DataFrame:
    """The clusters of the module graph's tables, if those of one part type belong together."""
    held, links = module_graph(s, d)
    tables = clusters.clustered_tables(held)
    pairs = cut(clusters.relatedness(tables, links))
    labels = tables.select(F.col("id").alias("node"), F.element_at(F.split("name", "_"), 1).alias("community"))
    return clusters.described(tables, pairs, labels)[0]


def queries() -> dict:
    return {
        "described_clusters": _described,
        "path_sample": _sample,
        "path_calibration": lambda s, d: statistics.calibration_curve(_sample(s, d)),
        "zipped_pairs": _zipped,
        "ordered_paths": lambda s, d: numbered(table(s, d, "pages").select("page_id", names.normal_path(F.col("url")).alias("path")), "path", "page_id"),
        "maintained_edges": lambda s, d: maintained.graph_edges(s, _maintained(s, d)),
        "maintained_metrics": lambda s, d: maintained.graph_metrics(s, _maintained(s, d)),
        "impact_reports": _reports,
        "change_report": _change_report,
        "second_dialect_impact": _second,
        "tree_counts": lambda s, d: graph.tree_counts(nodes(s, d), edges(s, d)),
    }


def _reached(roots: str, depth: int) -> str:
    return f"""with recursive {GRAPH_SQL}, walk as (
  select root, root as node, 10000::bigint as c4, 0 as depth, [root] as path, []::bigint[] as seqs, []::varchar[] as types from ({roots})
  union all
  select root, v, (w.c4 * p.c4 + 5000) // 10000, depth + 1, list_append(path, v), list_append(seqs, p.seq), list_append(types, p.type) from walk w join prop p on w.node = p.u where depth < {depth} and not list_contains(path, v)
), best as (select * from (select *, row_number() over (partition by root, node order by c4 desc, depth, seqs) as r from walk where depth > 0) where r = 1),
named as (select b.root, b.node, b.c4, b.depth, n.type, coalesce(n.name, b.node) as name, {TIER} as tier, {EVIDENCE} as evidence from best b left join nodes n on n.id = b.node)"""


_SPOTS = """dyn as (select count(*) as n from edges where type = 'dynamic_unresolved'),
spots as (select 'dynamic_unresolved_sql' as kind, case when n > 5 then 'HIGH' when n > 0 then 'MEDIUM' else 'INFO' end as severity, n from dyn union all select 'cross_service_boundary', 'MEDIUM', 0
  union all select 'unreferenced_tables', 'LOW', count(*) from (select distinct lower(name) as name from nodes where type in ('table', 'view') and lower(name) not in (select lower(replace(target, 'table:', '')) from edges where type in ('static_sql_string', 'orm_call'))) having count(*) > 0)"""
_PATHS = f"""with {GRAPH_SQL}, e as (select source, target, c4, seq % 10007 * 7919 % 10000 < c4 as actual from edges),
one as (select target as t, [source, target] as nodes, c4, actual from e where source <> target),
two as (select e.target as t, list_append(nodes, e.target) as nodes, (one.c4 * e.c4 + 5000) // 10000 as c4, one.actual and e.actual as actual from one join e on t = source where not list_contains(nodes, e.target)),
three as (select e.target as t, list_append(nodes, e.target) as nodes, (two.c4 * e.c4 + 5000) // 10000 as c4, two.actual and e.actual as actual from two join e on t = source where not list_contains(nodes, e.target)),
every as (select '1' as hops, array_to_string(nodes, ' > ') as path, c4, actual from one union all select '2', array_to_string(nodes, ' > '), c4, actual from two union all select '3', array_to_string(nodes, ' > '), c4, actual from three),
sample as (select hops, path, c4 / 10000.0::double as p, actual::bigint as actual from (select *, row_number() over (partition by hops order by md5('42:' || path)) as r from every) where r <= case hops when '1' then {HOPS["1"]} else {HOPS["2"]} end)"""
_PLAIN = "regexp_replace(replace(lower(trim(url)), chr(92), '/'), '^[./]+', '')"
_REPLAYED = """last as (select user_id, arg_max(event_id, ts) as i, arg_max(event_type, ts) as k from events group by 1),
refs as (select distinct 'file:u' || user_id as source, 'table' as x, unnest([k, 't' || i % 5, 't' || i % 3]) as target from last where k <> 'error')"""
_SHOP = "'table:shop.' || lower(p_type) || '_' || string_split(p_name, ' ')[2]"
SQL = {
    "described_clusters": f"""with l as (select l_orderkey as o, l_linenumber as i, {_SHOP} as id from lineitem join part on l_partkey = p_partkey), k as (select distinct x.id as s, y.id as t from l x join l y on x.o = y.o and y.i = x.i + 1),
      t as (select distinct o, id from l), n as (select distinct {_SHOP} as id, lower(p_type) || '_' || string_split(p_name, ' ')[2] as name, lower(p_type) as f from part),
      e as (select least(s, t) as a, greatest(s, t) as b, 10000 as w from k where s <> t union all select x.id, y.id, 5000 from t x join t y on x.o = y.o and x.id < y.id union all select x.id, y.id, 9200 from n x join n y on x.f = y.f and x.id < y.id),
      pairs as (select a, b, sum(w)::bigint as w from e group by a, b), held as (select id, name, string_split(name, '_')[1] as community from n where id in (select a from pairs union select b from pairs)),
      inside as (select x.community, p.* from pairs p join held x on x.id = a join held y on y.id = b where x.community = y.community),
      degrees as (select id, sum(w) as degree from (select a as id, w from inside union all select b, w from inside) group by id),
      m as (select community, count(*) as size, first(name order by coalesce(degree, 0) desc, id) as hub from held left join degrees using (id) group by community),
      i as (select community, count(*) as n, sum(w)::bigint as inner_weight from inside group by community),
      w as (select community, name, unnest(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 3)) as word, generate_subscripts(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 3), 1) as place from held),
      c as (select community, word, count(*) as n, min(name || chr(1) || place) as begins, count(*) filter (where place = 1) as firsts, min(name) filter (where place = 1) as first_at from w group by 1, 2),
      top as (select * from (select *, row_number() over (partition by community order by n desc, begins) as r from c where word not in ('model', 'data', 'item', 'items', 'type', 'types', 'table', 'info', 'custom', 'base', 'assigned', 'entry', 'entries', 'record', 'records')) where r <= 3),
      f as (select community, word as prefix from (select *, row_number() over (partition by community order by firsts desc, first_at, word) as r from c where firsts > 0) where r = 1),
      q as (select m.*, coalesce((select prefix from f where f.community = m.community and prefix in (select word from top where top.community = m.community)), (select word from top where top.community = m.community and r = 1), hub) as lead from m),
      s as (select q.*, (select first(word order by r) from top where top.community = q.community and word <> lead and length(word) >= 4) as second from q)
      select row_number() over (order by size desc, community) as place, community, case when size = 1 then upper(hub[1]) || hub[2:] || ' Module' else upper(lead[1]) || lead[2:] || coalesce(' & ' || upper(second[1]) || second[2:], '') || ' Domain' end as label,
        hub, size, (case when size < 2 then 10000 else coalesce(n, 0) * 20000 // (size * (size - 1)) end)::bigint as density_c4, coalesce(inner_weight, 0)::bigint as inner_weight from s left join i using (community)""",
    "path_sample": f"{_PATHS} select hops, path, p, actual from sample",
    "path_calibration": f"""{_PATHS}, b as (select least(floor(p * 10), 9)::bigint as bucket, count(*) as n, avg(p) as mean, avg(actual) as accuracy from sample group by 1)
      select i as bucket, coalesce(n, 0) as n, round(mean, 4) as mean, round(accuracy, 4) as accuracy, round(abs(mean - accuracy), 4) as error, coalesce(n, 0) < 10 as too_few, case when coalesce(n, 0) < 10 then true else abs(mean - accuracy) <= 0.15 end as within
      from (select unnest(range(10)) as i) left join b on bucket = i""",
    "zipped_pairs": """with p as (select row_number() over (order by doc_id) as place, (n_chars % 997) / 997.0::double as p from documents where doc_id in (select doc_id from labels)),
      q as (select row_number() over (order by doc_id) as place, quality::bigint as actual from labels) select place, p, actual from p join q using (place)""",
    "ordered_paths": f"select page_id, {_PLAIN} as path, row_number() over (order by {_PLAIN}, page_id) as place from pages",
    "maintained_edges": f"with {_REPLAYED} select source, target, 1::bigint as n from refs",
    "maintained_metrics": f"with {_REPLAYED} select target, count(*)::bigint as n_references, count(*) as n_files from refs group by target",
    "impact_reports": f"""{_reached("select 'nation:' || n_nationkey as root from nation", 3)}, {_SPOTS},
      k as (select *, case when type = 'function' then 0 when type = 'file' then 1 when type in ('table', 'view', 'partition') then 2 else 3 end as kind from named),
      r as (select *, row_number() over (partition by root, kind order by c4 desc, depth, name, node) as place, [15, 10, 10, 0][kind + 1] as most from k),
      x as (select root, kind, count(*) as n, any_value(most) as most, coalesce(string_agg('  ' || upper(tier) || ' ' || (c4 + 5) // 100 || '.' || (c4 + 5) // 10 % 10 || '% ' || name || case when evidence <> '' then ', ' || evidence else '' end || ', hop ' || depth, chr(10) order by place) filter (where place <= most), '') as body from r group by root, kind),
      t as (select root, sum(n)::bigint as total, coalesce(sum(n) filter (where kind = 0), 0)::bigint as n0, coalesce(sum(n) filter (where kind = 1), 0)::bigint as n1, coalesce(sum(n) filter (where kind = 2), 0)::bigint as n2,
        string_agg(['Functions:', 'Files:', 'Tables:', 'Others:'][kind + 1] || case when body <> '' then chr(10) || body else '' end || case when n > most then chr(10) || '  and ' || n - most || ' more' else '' end, chr(10) order by kind) as body from x group by root)
      select 'nation:' || n_nationkey as root, 'Impact of ' || n_name || ' [table]' || chr(10) || coalesce(total, 0) || ' affected: ' || coalesce(n0, 0) || ' functions, ' || coalesce(n1, 0) || ' files, ' || coalesce(n2, 0) || ' tables' || chr(10)
        || coalesce(body || chr(10), '') || 'Not visible:' || chr(10) || (select string_agg('  ' || severity || ' ' || kind || ': ' || n, chr(10) order by kind) from spots) as report from nation left join t on root = 'nation:' || n_nationkey""",
    "change_report": f"""{_reached("select 'supplier:' || s_suppkey as root from supplier", 1)}, {_SPOTS},
      c as (select distinct regexp_replace(url, '^[a-z]+://[^/]+', '.') as path from pages), o as (select path, row_number() over (order by path) as place from c),
      r as (select root, '| ' || coalesce(type, 'unknown') || ' | `' || name || '` | ' || tier || ' | ' || depth || ' | ' || evidence || ' |' as line, row_number() over (partition by root order by c4 desc, depth, name, node) as place from named),
      x as (select root, count(*) as total, string_agg(line, chr(10) order by place) filter (where place <= 12) as shown, string_agg(line, chr(10) order by place) filter (where place between 13 and 212) as folded from r group by root),
      s as (select s_name as name, 'supplier:' || s_suppkey as root, coalesce(total, 0) as total, shown, folded, row_number() over (order by s_name, 'supplier:' || s_suppkey) as place from supplier left join x on root = 'supplier:' || s_suppkey),
      h as (select '| type | name | tier | hop | evidence |' || chr(10) || '|-|-|-|-|-|' as h)
      select 0::bigint as place, '## Changed files (' || count(*) || ')' || coalesce(chr(10) || string_agg('- `' || path || '`', chr(10) order by place) filter (where place <= 15), '') || case when count(*) > 15 then chr(10) || '- and ' || count(*) - 15 || ' more files' else '' end || chr(10)
        || (select '**' || count(*) || '** affected tables, **' || sum(total) || '** impacted entities, **' || max(total) || '** at most; **' || count(*) filter (where total >= 5) || '** tables with 5 or more' from s) as section from o
      union all select place, '### `' || name || '`: ' || total || chr(10) || case when total = 0 then 'Nothing depends on it.' else h || chr(10) || shown || case when total > 12 then chr(10) || '<details><summary>' || total - 12 || ' more</summary>' || chr(10) || chr(10) || h || chr(10) || folded
        || case when total > 212 then chr(10) || 'and ' || total - 212 || ' more' else '' end || chr(10) || '</details>' else '' end end from s cross join h
      union all select (select count(*) + 1 from supplier), '## Not visible' || chr(10) || string_agg('- **' || severity || '** ' || kind || ': ' || n, chr(10) order by kind) from spots""",
    "second_dialect_impact": f"""{_reached("select 'nation:' || n_nationkey as root from nation", 2)}, told as (select node, first(kind order by seq, kind) as kind from (select source as node, seq, 'file' as kind from edges union all select target, seq, 'table' from edges) group by node),
      k as (select root, n.node, case when n.type in ('function', 'view') or n.type is null then t.kind else n.type end as type, case when n.type in ('function', 'view') then n.node else n.name end as name, c4, depth from named n left join told t on t.node = n.node)
      select root, node, type, name, c4, depth::bigint as depth, case type when 'function' then 'functions' when 'file' then 'files' when 'table' then 'tables' when 'view' then 'tables' end as listed from k""",
    "tree_counts": f"with {GRAPH_SQL}, e as (select count(*) as edges, count(*) filter (where type = 'dynamic_unresolved') as dynamic from edges) select (select count(*) from nodes) as nodes, edges, dynamic, ((dynamic * 2000 + edges) // (2 * edges))::bigint as dynamic_tenths from e",
}
