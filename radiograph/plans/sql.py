"""The registered queries in SQL."""

from __future__ import annotations

from ..functions.names import ABBREVIATIONS, IRREGULAR


def _case(values: dict[str, str], key: str) -> str:
    return f"(case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end)"


def plural(w: str) -> str:
    return (
        f"coalesce({_case(IRREGULAR, w)}, case when regexp_matches({w}, '(s|x|z|ch|sh)$') then {w} || 'es' when regexp_matches({w}, '[^aeiou]y$') then regexp_replace({w}, 'y$', 'ies')"
        f" when regexp_matches({w}, 'fe?$') then regexp_replace({w}, 'fe?$', 'ves') else {w} || 's' end)"
    )


def singular(w: str) -> str:
    return (
        f"coalesce({_case({p: s for s, p in IRREGULAR.items()}, w)}, case when right({w}, 1) <> 's' then {w} when regexp_matches({w}, '.ies$') then regexp_replace({w}, 'ies$', 'y')"
        f" when regexp_matches({w}, '(ses|ches|shes|xes|zes)$') then {w}[:-3] when right({w}, 3) = 'ves' then {w}[:-4] || 'f' when regexp_matches({w}, '.oes$') then {w}[:-3]"
        f" when right({w}, 2) = 'ss' then {w} else {w}[:-2] end)"
    )


def candidates(source: str, stem: str = "stem", keep: str = "stem") -> str:
    """Rows (keep, name, m10) of the candidates of source's stems."""
    short, last_short = _case(ABBREVIATIONS, "stem"), _case(ABBREVIATIONS, "tail")
    exact = f"[stem, {plural('stem')}, {singular('stem')}, case when compound then head || {plural('tail')} end, case when compound then head || {singular('tail')} end]"
    fuzzy = f"[case when compound then tail end, case when compound then {plural('tail')} end, case when compound then {singular('tail')} end, case when compound then last_short end, case when compound then {plural('last_short')} end, short, {plural('short')}, {singular('short')}]"
    return f"""(
      with p as (select *, string_split(stem, '_')[-1] as tail, regexp_replace(stem, '[^_]*$', '') as head, contains(stem, '_') as compound from {source}),
      q as (select *, {short} as short, {last_short} as last_short from p),
      r as (select {keep}, unnest({exact}) as name, 10 as m10 from q union all select {keep}, unnest({fuzzy}), 9 from q)
      select {keep}, name, max(m10)::int as m10 from r where name is not null group by {keep}, name)"""


WORDS = "(select distinct w from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as w from documents) where w <> '')"
STEMS = f"(select replace(lower(p_name), ' ', '_') as stem from part union select w from {WORDS})"
TIER = """case when list_has_any(types, ['dynamic_unresolved', 'inferred_naming']) or c4 < 7000 then 'Low' when list_has_any(types, ['orm_call', 'static_sql_string']) then 'Medium'
  when len(list_filter(types, lambda t: t not in ('declared_fk', 'structural_belongs_to'))) = 0 or c4 >= 9000 then 'High' else 'Medium' end"""
SHOWN = "case t when 'declared_fk' then 'FK' when 'structural_belongs_to' then 'file membership' when 'orm_call' then 'ORM call' when 'static_sql_string' then 'static SQL' when 'inferred_naming' then 'naming inference' when 'dynamic_unresolved' then 'dynamic query' end"
EVIDENCE = f"case when len(types) = 0 then '' else 'via ' || array_to_string(list_transform(types, lambda t: {SHOWN}), ' → ') end"

PAIRS = """touches as (select distinct l_orderkey as g, p_brand as item from lineitem join part on l_partkey = p_partkey),
pairs as (select x.item as a, y.item as b, count(*) as w from touches x join touches y on x.g = y.g and x.item < y.item group by 1, 2),
labels as (select distinct p_brand as node, regexp_extract(p_brand, '([0-9]+)', 1)::bigint % 5 as community from part),
degrees as (select node, sum(w)::bigint as degree from (select a as node, w from pairs union all select b, w from pairs) group by node)"""

CATALOG = """part_names as (select p_partkey, lower(p_type) as schema, replace(lower(p_name), ' ', '_') as name, lower(p_type) || '.' || replace(lower(p_name), ' ', '_') as full_name from part),
tables as (select distinct full_name, schema, name, length(full_name)::bigint as seq from part_names),
lines as (select distinct l_orderkey, l_partkey, l_linenumber from lineitem),
stems as (select distinct x.full_name as source, x.schema, x.name as bare, y.name as stem from (select * from lines join part_names on l_partkey = p_partkey) x
  join (select * from lines join part_names on l_partkey = p_partkey) y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1),
keys as (select name as key, full_name as target, schema as target_schema, seq, 0 as suffix from tables
  union all select regexp_extract(name, '^[^_]*_(.+)$', 1), full_name, schema, seq, 1 from tables where contains(name, '_')),
lookup as (select key, target, target_schema from (select *, row_number() over (partition by key order by seq, suffix, target) as r from keys where key <> '') where suffix = 0 or r = 1)"""


def _infer() -> str:
    return f"""{CATALOG},
asked as (select * from {candidates('stems', keep='source, schema, bare, stem')}),
hits as (select *, max((schema = target_schema)::int) over (partition by source, stem, key) as any_same, (schema = target_schema)::int as same from asked join lookup on name = key),
inferred as (select source, target, (9200 * max(m10) // 10)::bigint as c4, case when max(m10) = 10 then 'exact' else 'fuzzy' end as match_type,
  'Naming inference (' || case when max(m10) = 10 then 'exact' else 'fuzzy' end || '): ' || source || '.' || first(stem order by m10 desc, stem) || '_id -> ' || target as evidence from hits
  where same = any_same and not (source = target and (stem = bare or stem = {singular('bare')})) group by source, target)"""


CODE = """code as (select o_custkey as c, o_orderkey as o, l_linenumber as i, l_returnflag as flag, lower(replace(p_brand, '#', '')) as b, lower(string_split(p_name, ' ')[2]) as w
  from orders join customer on o_custkey = c_custkey left join (select * from lineitem join part on l_partkey = p_partkey) l on l_orderkey = o_orderkey)"""


def naive(w: str) -> str:
    return f"(case when regexp_matches({w}, '[^aeiou]y$') then {w}[:-2] || 'ies' when regexp_matches({w}, '(s|sh|ch|x)$') then {w} || 'es' else {w} || 's' end)"


def _extracted(extension: str, model: str | None, dynamic: bool, once: bool = False, repository: bool = False) -> str:
    """The edges that a customer's file holds, from the rows it was made of."""
    func = f"'func:src/c' || c || '.{extension}:order_' || o"
    parts = [f"select distinct {func} as source, 'file:src/c' || c || '.{extension}' as target, 'structural_belongs_to' as type, 10000::bigint as c4, 1 as one from code"]
    if model:
        parts.append(f"select {func}, 'table:' || {model}, 'orm_call', 9800, 1 from code where flag = 'A'")
    parts.append(f"select {func}, 'table:' || b, 'static_sql_string', 9600, 1 from code where flag = 'R'")
    if dynamic:
        parts.append(f"select {func}, 'table:unresolved', 'dynamic_unresolved', 1500, 1 from code where flag not in ('A', 'R')")
    if repository:
        own = f"'func:src/c' || c_custkey || '.{extension}:Orders' || c_custkey"
        parts.append(f"select {own}, 'file:src/c' || c_custkey || '.{extension}', 'structural_belongs_to', 10000, 1 from customer where c_custkey in (select c from code)")
        parts.append(f"select {own}, 'table:' || {naive('lower(c_mktsegment)')}, 'orm_call', 9800, 1 from customer where c_custkey in (select c from code)")
    n = "case when type = 'dynamic_unresolved' then count(*) else 1 end" if once else "count(*)"
    return f"with {CODE}, e as ({' union all '.join(parts)}) select source, target, type, c4, {n} as n from e group by source, target, type, c4"


def statements(graph: str) -> dict[str, str]:
    def reached(roots: str, depth: int, least: int = 0) -> str:
        return f"""with recursive {graph}, walk as (
  select root, root as node, 10000::bigint as c4, 0 as depth, [root] as path, []::bigint[] as seqs, []::varchar[] as types from ({roots})
  union all
  select root, v, (w.c4 * p.c4 + 5000) // 10000, depth + 1, list_append(path, v), list_append(seqs, p.seq), list_append(types, p.type)
  from walk w join prop p on w.node = p.u where depth < {depth} and not list_contains(path, v) and (w.c4 * p.c4 + 5000) // 10000 >= {least}
), best as (select * from (select *, row_number() over (partition by root, node order by c4 desc, depth, seqs) as r from walk where depth > 0) where r = 1)"""

    nation, all_nations = "select 'nation:3' as root", "select 'nation:' || n_nationkey as root from nation"
    columns = f"select root, node, c4, depth::bigint as depth, {TIER} as tier, {EVIDENCE} as evidence, array_to_string(path, ' > ') as path from best"
    docs = "(select (n_chars % 997) / 997.0::double as p, quality::bigint as actual, lang, toxic from documents join labels using (doc_id))"
    declared = """declared as (select distinct x.full_name as source, y.full_name as target, 'declared_fk' as type, 10000::bigint as c4 from (select * from lineitem join part_names on l_partkey = p_partkey) x
          join (select * from lineitem join part_names on l_partkey = p_partkey) y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1), guessed as (select source, target, 'inferred_naming' as type, c4 from inferred)"""
    order_table = "(select o_custkey as c, o_orderkey::varchar as o, lag(o_orderkey::varchar) over (partition by o_custkey order by o_orderkey) as p from orders)"
    shop = "'table:shop.' || lower(p_type) || '_' || string_split(p_name, ' ')[2]"
    brand = "lower(replace(p_brand, '#', ''))"
    bounded_name = lambda t, n: f"regexp_matches(lower({t}), '(^|[^a-z0-9])' || regexp_escape(lower({n})) || '($|[^a-z0-9])')"
    page = "regexp_replace(url, '^[a-z]+://[^/]+', '.')"
    changed = f"""pg as (select page_id, {page} as file from pages), scripts as (select distinct 'db/001_create_' || p_name || '.sql' as path, 'db/001_create_' || p_name || '.sql' as t from part
            union all select 'db/n' || n_nationkey || '.sql', 'db/n' || n_nationkey || '.sql' from nation union all select 'db/n' || n_nationkey || '.sql', 'alter table ' || n_name || '_x' from nation),
          changed as (select file as path from pg union select path from scripts),
          named as (select distinct name from nodes where type in ('table', 'view') and name <> '<unresolved_dynamic_query>'),
          cp as (select distinct regexp_replace(replace(lower(trim(path)), chr(92), '/'), '^[./]+', '') as p from changed),
          moved as (select distinct k || page_id as id from (select page_id, regexp_replace(replace(lower(trim(file)), chr(92), '/'), '^[./]+', '') as p from pg) f, (values ('orders:'), ('supplier:')) v(k)
            where p <> '' and exists (select 1 from cp where cp.p = f.p)
            union select source from edges where type = 'structural_belongs_to' and regexp_replace(lower(trim(replace(target, 'file:', ''))), '^[./]+', '') in (select p from cp)),
          affected as (select name from nodes where type in ('table', 'view') and name <> '<unresolved_dynamic_query>' and (id in (select target from edges where source in (select id from moved where id not like 'supplier:%')) or (id in (select id from moved) and id like 'supplier:%'))
            union select name from named where exists (select 1 from scripts where {bounded_name('t', 'name')}))"""
    impact = lambda roots: f"""{reached(roots, 1).replace(graph, graph + ', ' + changed, 1)}, chosen as (select a.name, first(n.id order by n.seq) as root from affected a join nodes n on lower(n.name) = lower(a.name) group by a.name),
          each as (select root, count(*) as total, count(*) filter (where t.type = 'function') as functions, count(*) filter (where t.type = 'file') as files, count(*) filter (where t.type in ('table', 'view', 'partition')) as tables, max(depth)::bigint as deepest
            from best b left join nodes t on t.id = b.node group by root),
          impacted as (select c.name, c.root, coalesce(total, 0) as total, coalesce(functions, 0) as functions, coalesce(files, 0) as files, coalesce(tables, 0) as tables, coalesce(deepest, 0) as deepest, coalesce(total, 0) >= 5 as high_risk from chosen c left join each e on e.root = c.root)"""  # noqa: E731
    chosen = "select distinct root from (select a.name, first(n.id order by n.seq) as root from affected a join nodes n on lower(n.name) = lower(a.name) group by a.name)"
    merged = f"with {_infer()}, {declared} select d.*, exists (select 1 from guessed g where g.source = d.source and g.target = d.target) as agreed from declared d union all select g.*, exists (select 1 from declared d where g.source = d.source and g.target = d.target) as agreed from guessed g"
    normal = lambda x: f"regexp_replace(replace(lower(trim({x})), chr(92), '/'), '^[./]+', '')"
    part_id = "'table:' || lower(p_type) || '.' || lower(p_name)"
    z = "1.96"
    bound = lambda sign, pick, edge: f"round({pick}({edge}, (tp / n::double + {z} * {z} / (2 * n) {sign} {z} * sqrt((tp / n::double) * (1 - tp / n::double) / n + {z} * {z} / (4 * n * n::double))) / (1 + {z} * {z} / n)), 4)"
    out = {
        "blast_radius_nation": f"{reached(nation, 3)} {columns}",
        "blast_radius_min_conf": f"{reached(nation, 3, 9500)} {columns}",
        "blast_radius_multi_root": f"{reached(all_nations, 2)} {columns}",
        "change_impact_summary": f"""{reached("select 'supplier:' || s_suppkey as root from supplier", 1)} select root, count(*) as total, count(*) filter (where t.type = 'function') as functions,
          count(*) filter (where t.type = 'file') as files, count(*) filter (where t.type in ('table', 'view', 'partition')) as tables, max(depth)::bigint as deepest, count(*) >= 5 as high_risk from best b left join nodes t on t.id = b.node group by root""",
        "tier_distribution": f"{reached(all_nations, 2)} select {TIER} as tier, {EVIDENCE} as evidence, count(*) as n, sum(c4)::bigint as total_c4 from best group by 1, 2",
        "parallel_edge_collapse": f"with {graph} select u, v, c4, type, seq from prop",
        "resolve_target": f"""with {graph}, wanted as (select lower(s_name) as target from supplier union select 'customer:' || c_custkey from customer union select n_name from nation union select o_orderkey || 'x' from orders union select 'unresolved'
            union select unnest([p_name || 's', upper(p_brand || '.' || p_name || 's'), p_type || '.' || p_brand || '.' || p_name || 's']) from part),
          n as (select seq, id, name from nodes union all select 9000000000000000 + p_partkey, 'table:' || lower(p_type) || '.' || lower(p_brand) || '.' || lower(p_name) || 's', 't' || p_partkey from part),
          dots as (select id, seq, lower(replace(id, 'table:', '')) as clean from n where contains(id, '.')), dotted_ends as (select id, seq, clean[p + 1:] as k from (select *, unnest(list_filter(range(1, length(clean) + 1), lambda p: clean[p] = '.')) as p from dots)),
          hits as (select target, id, 1 as way, seq from wanted join n on id = target union all select target, id, 2, seq from wanted join n on id = 'table:' || lower(target)
            union all select target, id, 3, seq from wanted join n on lower(name) = lower(target) union all select target, id, 3, seq from wanted join n on lower(id) = lower(target) union all select target, id, 3, seq from wanted join n on lower(replace(id, 'table:', '')) = lower(target)
            union all select target, id, 4, seq from wanted join dotted_ends on k = lower(target) where target <> '')
          select w.target, first(h.id order by way, seq, h.id) filter (where h.id is not null) as id from wanted w left join hits h using (target) group by w.target""",
        "node_breakdown": f"with {graph} select type, count(*) as n from nodes group by type",
        "edge_breakdown": f"with {graph} select type, count(*) as n from edges group by type",
        "graph_metrics": f"""with {graph}, c as (select count(*) as total_edges, count(*) filter (where type = 'dynamic_unresolved') as dynamic, count(*) filter (where type in ('static_sql_string', 'orm_call')) as resolved,
            count(distinct target) filter (where type in ('static_sql_string', 'orm_call')) as tables_touched, count(distinct source) filter (where type in ('static_sql_string', 'orm_call')) as functions_accessing from edges)
          select total_edges, dynamic, dynamic + resolved as access_calls, coalesce((dynamic * 20000 + dynamic + resolved) // nullif(2 * (dynamic + resolved), 0), 0)::bigint as dynamic_ratio_c4,
            coalesce((dynamic * 20000 + dynamic + resolved) // nullif(2 * (dynamic + resolved), 0), 0) > 4000 as warning, tables_touched, functions_accessing from c""",
        "blind_spots": f"""with {graph}, dyn as (select source, min(seq) as seq from edges where type = 'dynamic_unresolved' group by source),
            n as (select count(*) as n from edges where type = 'dynamic_unresolved'),
            missing as (select distinct lower(name) as name from nodes where type in ('table', 'view') and lower(name) not in (select lower(replace(target, 'table:', '')) from edges where type in ('static_sql_string', 'orm_call')))
          select 'dynamic_unresolved_sql' as kind, case when n > 5 then 'high' when n > 0 then 'medium' else 'info' end as severity, n, (select coalesce(string_agg(source, ',' order by seq, source), '') from (select * from dyn order by seq, source limit 10)) as examples from n
          union all select 'cross_service_boundary', 'medium', 0, '' union all select 'unreferenced_tables', 'low', count(*), (select string_agg(name, ',' order by name) from (select name from missing order by name limit 10)) from missing having count(*) > 0""",
        "unreferenced_tables": f"with {graph} select distinct lower(name) as name from nodes where type in ('table', 'view') and lower(name) not in (select lower(replace(target, 'table:', '')) from edges where type in ('static_sql_string', 'orm_call'))",
        "reconcile_targets": f"""with t as (select {part_id} as id, lower(p_name) as name, p_partkey as seq from part), bare as (select name, first(id order by seq, id) as id from t group by name),
          calls as (select case when l_linenumber % 2 = 0 then 'table:' || p_name else 'table:' || lower(p_type) || '.' || p_name end as target from lineitem join part on l_partkey = p_partkey)
          select coalesce(q.id, b.id, c.target) as target, count(*) as n from calls c left join (select distinct id from t) q on lower(replace(q.id, 'table:', '')) = lower(replace(c.target, 'table:', ''))
          left join bare b on b.name = lower(replace(c.target, 'table:', '')) group by 1""",
        "pluralize": f"select w, {plural('w')} as plural from {WORDS}",
        "singularize": f"select w, {singular('w')} as singular from {WORDS}",
        "candidate_names": f"select * from {candidates(STEMS)}",
        "infer_naming": f"with {_infer()} select * from inferred",
        "merge_agreement": merged,
        "merge_dedup": f"select * from ({merged}) where not (type = 'inferred_naming' and agreed)",
        "merge_stats": f"""with {_infer()}, {declared}, f as (select (d.source is not null) as d, (g.source is not null) as g from declared d full join guessed g on d.source = g.source and d.target = g.target)
          select count(*) filter (where d and g) as agreements, count(*) filter (where not d) as inferred_only, count(*) filter (where not g) as declared_only,
          coalesce((count(*) filter (where d and g) * 20000 + count(*) filter (where g)) // nullif(2 * count(*) filter (where g), 0), 0)::bigint as agreement_rate_c4 from f""",
        "extract_python": _extracted("py", naive("w"), True),
        "extract_javascript": _extracted("js", plural("w"), True, once=True),
        "extract_go": _extracted("go", naive("w"), False),
        "extract_java": _extracted("java", None, False, repository=True),
        "extract_ruby": _extracted("rb", naive("w"), False),
        "extract_php": _extracted("php", naive("w"), False),
        "extract_literals": f"""with {CODE}, q as (select c, b, row_number() over (partition by c order by o, i, 'run("SELECT id FROM ' || b) as k from code where flag = 'R'),
          e as (select 'func:src/c' || c || '.rs:query_' || k as source, unnest([{{'t': 'file:src/c' || c || '.rs', 'y': 'structural_belongs_to', 'w': 10000}}, {{'t': 'table:' || b, 'y': 'static_sql_string', 'w': 9600}}]) as x from q)
          select source, x.t as target, x.y as type, x.w::bigint as c4, count(*) as n from e group by all""",
        "line_classifier": f"""with {CODE}, k as (select c, case when flag = 'A' then 'orm' when flag = 'R' then 'static' else 'dynamic' end as kind from code where flag is not null
          union all select distinct c, null from code union all select c, null from (select distinct c, o from code))
          select 'src/c' || c || '.py' as path, kind, count(*) as n from k group by c, kind""",
        "function_bounds": f"""with {CODE}, f as (select c, o, count(flag) + 1 as n from code group by c, o), g as (select *, sum(n) over (partition by c order by o) as total from f)
          select 'src/c' || c || '.js' as path, 'order_' || o as name, (total - n + 2)::bigint as start_line, (total + 1)::bigint as end_line from g""",
        "sql_table_refs": """with m as (select doc_id, regexp_extract_all(text, '(?i)\\b(?:FROM|JOIN|INTO|UPDATE)\\s+([`"'']?[a-zA-Z0-9_]+[`"'']?(?:\\.[`"'']?[a-zA-Z0-9_]+[`"'']?)?)', 1) as x from documents),
          e as (select doc_id, unnest(x) as r, generate_subscripts(x, 1) as i from m), c as (select doc_id, i, lower(string_split(regexp_replace(r, '[`"'']', '', 'g'), '.')[-1]) as table_name from e),
          f as (select doc_id, table_name, min(i) as i from c where table_name not in ('select', 'where', 'values', 'set', 'order', 'group', 'having', 'limit') group by 1, 2)
          select doc_id, (row_number() over (partition by doc_id order by i) - 1)::bigint as place, table_name from f""",
        "path_suffix_match": f"""with a as (select distinct {normal("regexp_replace(url, '^[a-z]+://', '')")} as x from pages), b as (select distinct {normal(page)} as y from pages)
          select x as left_path, y as right_path from a join b on x = y or ends_with(x, '/' || y) or ends_with(y, '/' || x) where x <> '' and y <> ''""",
        "sql_file_mentions": f"""with n as (select distinct unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as name from benchmark), two as (select distinct regexp_extract(lower(text), '^[a-z0-9]+ [a-z0-9]+') as name from benchmark),
          t as (select distinct conv_id || ':' || turn as id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as name from conversations) select id, name from t where name in (select name from n where name <> '')
          union select conv_id || ':' || turn, name from conversations join two on {bounded_name('text', 'name')} where name <> ''""",
        "affected_tables": f"with {graph}, {changed} select name from affected",
        "change_impact": f"{impact(chosen)} select * from impacted",
        "change_impact_total": f"{impact(chosen)} select (select count(*) from changed) as changed_files, count(*) as affected_tables, coalesce(sum(total), 0)::bigint as impacted, coalesce(max(total), 0) as largest, count(*) filter (where high_risk) as high_risk from impacted",
        "infer_undeclared": f"with {_infer().replace('not (source = target and', 'not exists (select 1 from declared_pairs d where d.source = hits.source and d.target = hits.target) and not (source = target and').replace('hits as (', "declared_pairs as (select distinct x.full_name as source, y.full_name as target from (select * from lineitem join part_names on l_partkey = p_partkey) x join (select * from lineitem join part_names on l_partkey = p_partkey) y on x.l_orderkey = y.l_orderkey and y.l_linenumber = x.l_linenumber + 1), hits as (")} select * from inferred",
        "ddl_columns": f"""with t as (select * from {order_table}), x as (select c, o, p, unnest([{{'n': 'id', 't': 'integer', 'k': true, 'z': false, 'w': true}}, {{'n': 'total', 't': 'numeric(10, 2)', 'k': false, 'z': false, 'w': true}}, {{'n': 'note', 't': 'varchar(20)', 'k': false, 'z': true, 'w': true}},
            {{'n': 'prev_id', 't': 'integer', 'k': false, 'z': true, 'w': p is not null}}, {{'n': 'cust_id', 't': 'integer', 'k': false, 'z': true, 'w': true}}]) as f from t)
          select 'schema/c' || c || '.sql' as path, 'orders_' || o as "table", f.n as "column", f.t as type, f.k as primary_key, f.z as nullable from x where f.w""",
        "ddl_keys": f"""select 'schema/c' || c || '.sql' as path, 'orders_' || o as "table", 'prev_id' as "column", 'orders_' || p as target, 'id' as target_column from {order_table} where p is not null
          union all select 'schema/c' || c || '.sql', 'orders_' || o, 'cust_id', 'customers', 'id' from {order_table}""",
        "prisma_columns": f"""with t as (select * from {order_table}), x as (select c, o, p, unnest([{{'n': 'id', 't': 'Int', 'k': true, 'w': true}}, {{'n': 'total', 't': 'Float?', 'k': false, 'w': true}}, {{'n': 'prev', 't': 'Order' || p, 'k': false, 'w': p is not null}}, {{'n': 'prev_id', 't': 'Int', 'k': false, 'w': p is not null}}]) as f from t)
          select 'schema/c' || c || '.prisma' as path, 'order' || o || 's' as "table", f.n as "column", f.t as type, f.k as primary_key, ends_with(f.t, '?') as nullable from x where f.w""",
        "prisma_keys": f"""select 'schema/c' || c || '.prisma' as path, 'order' || o || 's' as "table", 'prev_id' as "column", 'order' || p || 's' as target, 'id' as target_column from {order_table} where p is not null""",
        "rails_columns": f"""with t as (select * from {order_table}), x as (select c, o, p, unnest([{{'n': 'id', 't': 'INTEGER', 'k': true, 'z': false, 'w': true}}, {{'n': 'total', 't': 'FLOAT', 'k': false, 'z': true, 'w': true}}, {{'n': 'order_' || p || '_id', 't': 'INTEGER', 'k': false, 'z': false, 'w': p is not null}}]) as f from t)
          select 'schema/c' || c || '.rb' as path, 'orders_' || o as "table", f.n as "column", f.t as type, f.k as primary_key, f.z as nullable from x where f.w""",
        "rails_keys": f"""select 'schema/c' || c || '.rb' as path, 'orders_' || o as "table", 'order_' || p || '_id' as "column", 'order_' || p || 's' as target, 'id' as target_column from {order_table} where p is not null
          union all select 'schema/c' || c || '.rb', 'orders_' || o, 'customer_id', 'customers', 'id' from {order_table}""",
        "assembled_graph": f"""with {CODE}, t as (select distinct 'table:shop.' || {brand} as id, {brand} as name from part), u as (select distinct 'table:' || {naive('w')} as id from code where flag = 'A')
          select id, 'table' as type, name, 'postgres' as source_system from t union all select distinct 'func:src/c' || c || '.py:order_' || o, 'function', 'order_' || o, 'python' from code
          union all select id, 'table', replace(id, 'table:', ''), 'code_inferred' from u union all select 'table:unresolved', 'table', '<unresolved_dynamic_query>', 'unresolved' from code where flag not in ('A', 'R') group by 1""",
        "assembled_edges": f"""with {CODE} select 'orm_call' as type, 'function' as source_type, 'table' as target_type, {naive('w')} as target_name, count(*) as n from code where flag = 'A' group by w
          union all select 'static_sql_string', 'function', 'table', b, count(*) from code where flag = 'R' group by b
          union all select 'dynamic_unresolved', 'function', 'table', '<unresolved_dynamic_query>', count(*) from code where flag not in ('A', 'R') group by 1""",
        "blind_spots_once": """with c as (select o_custkey as seq, count(*) as n from orders where o_orderstatus = 'P' group by 1)
          select n || ' calls cannot be resolved' as message, 'customer:' || min(seq) as root, 'dynamic_unresolved_sql' as kind, case when c.n > 5 then 'high' else 'medium' end as severity, count(*) as n from c group by c.n""",
        "most_common_words": """with w as (select lang, doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) as value, generate_subscripts(string_split_regex(lower(text), '[^a-z]+'), 1) - 1 as place from documents where lang is not null),
          c as (select lang as "group", value, count(*) as n, min(doc_id * 10000000 + place) as seq from w where value <> '' group by 1, 2)
          select "group", value, n, place from (select *, row_number() over (partition by "group" order by n desc, seq, value) as place from c) where place <= 5""",
        "touching_edges": f"""with {CODE} select 'table:shop.' || b as id, 'static_sql_string' as type, count(distinct (c, o)) as n from code where flag = 'R' group by b""",
        "table_relatedness": f"""with l as (select l_orderkey as o, l_linenumber as i, {shop} as id from lineitem join part on l_partkey = p_partkey), k as (select distinct x.id as s, y.id as t from l x join l y on x.o = y.o and y.i = x.i + 1),
          t as (select distinct o, id from l), n as (select distinct {shop} as id, lower(p_type) as f from part),
          e as (select least(s, t) as a, greatest(s, t) as b, 10000 as w from k where s <> t union all select x.id, y.id, 5000 from t x join t y on x.o = y.o and x.id < y.id union all select x.id, y.id, 9200 from n x join n y on x.f = y.f and x.id < y.id)
          select a, b, sum(w)::bigint as w from e group by a, b""",
        "cluster_labels": """with m as (select distinct lower(p_type) as community, lower(p_type) || '_' || replace(lower(p_name), ' ', '_') as name from part),
          w as (select community, name, unnest(list_filter(string_split(name, '_'), lambda x: length(x) >= 3)) as word, generate_subscripts(list_filter(string_split(name, '_'), lambda x: length(x) >= 3), 1) as place from m),
          c as (select community, word, count(*) as n, min(name || chr(1) || place) as begins, count(*) filter (where place = 1) as firsts, min(name) filter (where place = 1) as first_at from w group by 1, 2),
          t as (select * from (select *, row_number() over (partition by community order by n desc, begins) as r from c) where r <= 3),
          f as (select community, word as prefix from (select *, row_number() over (partition by community order by firsts desc, first_at, word) as r from c where firsts > 0) where r = 1),
          b as (select community, count(*) as size, min(name) as name from m group by 1),
          p as (select b.*, coalesce((select prefix from f where f.community = b.community and prefix in (select word from t where t.community = b.community)), (select word from t where t.community = b.community and r = 1), name) as lead from b),
          q as (select p.*, (select first(word order by r) from t where t.community = p.community and word <> lead and length(word) >= 4) as second from p)
          select community, case when size = 1 then upper(name[1]) || name[2:] || ' Module' else upper(lead[1]) || lead[2:] || coalesce(' & ' || upper(second[1]) || second[2:], '') || ' Domain' end as label from q""",
        "cooccurrence_projection": f"with {PAIRS} select * from pairs",
        "prefix_pairs": "with t as (select distinct string_split(p_name, ' ')[1] as g, p_brand as item from part) select x.item as a, y.item as b, count(*) as w from t x join t y on x.g = y.g and x.item < y.item group by 1, 2",
        "weighted_degree_hub": f"with {PAIRS} select * from degrees",
        "cluster_density": f"""with {PAIRS}, i as (select x.community, count(*) as inner_pairs, sum(w)::bigint as inner_weight from pairs join labels x on a = x.node join labels y on b = y.node where x.community = y.community group by 1),
          m as (select community, count(*) as size, first(node order by coalesce(degree, 0) desc, node) as hub from labels left join degrees using (node) group by community)
          select community, size, coalesce(inner_pairs, 0) as inner_pairs, coalesce(inner_weight, 0)::bigint as inner_weight, hub, (case when size < 2 then 10000 else inner_pairs * 20000 // (size * (size - 1)) end)::bigint as density_c4 from m left join i using (community)""",
        "modularity_q": f"""with {PAIRS}, i as (select x.community, sum(w) as inner_w from pairs join labels x on a = x.node join labels y on b = y.node where x.community = y.community group by 1),
          d as (select community, sum(degree) as d from degrees join labels using (node) group by community), m as (select sum(w)::double as m from pairs)
          select round(coalesce(sum(coalesce(inner_w, 0) / m - (d / (2 * m)) * (d / (2 * m))), 0.0), 6) as q from d left join i using (community) cross join m""",
        "adjusted_rand_index": """with c as (select o_orderstatus as t, o_orderpriority as p, count(*)::double as n from orders group by 1, 2), s as (select sum(n * (n - 1) / 2) as both_, sum(n) as total from c),
          a as (select sum(n * (n - 1) / 2) as a from (select sum(n) as n from c group by t)), b as (select sum(n * (n - 1) / 2) as b from (select sum(n) as n from c group by p))
          select round((both_ - a * b / (total * (total - 1) / 2)) / ((a + b) / 2 - a * b / (total * (total - 1) / 2)), 6) as ari from s, a, b""",
        "assemble_nodes": f"""with {graph}, b as (select 0 as layer, * from nodes union all select 1, seq + 9000000000000000, id, 'function', 'code:' || name from nodes where type in ('function', 'view'))
          select id, first(type order by layer desc, seq desc, type desc, name desc) as type, first(name order by layer desc, seq desc, type desc, name desc) as name, min(seq) as seq from b group by id""",
        "dangling_edges": f"with {graph}, n as (select id from nodes where type <> 'view') select type, count(*) as n from edges where source in (select id from n) and target in (select id from n) group by type",
        "one_hop_impact": f"with {graph} select target as root, source as node, type, c4 from edges where target in (select 'supplier:' || s_suppkey from supplier)",
        "neighbourhood": f"with {graph}, b as (select source as root, target as node from edges union select target, source from edges) select root, node from b where root <> node and root in (select 'nation:' || n_nationkey from nation)",
        "isolated_nodes": f"with {graph}, e as (select * from edges where type in ('orm_call', 'dynamic_unresolved') and source <> target) select id, name from nodes where id not in (select source from e union all select target from e)",
        "impact_ranking": f"""{reached(all_nations, 2)} select root, type, place, node, c4, depth::bigint as depth from (select b.root, t.type, row_number() over (partition by b.root, t.type order by b.c4 desc, b.depth, t.name, b.node) as place, b.node, b.c4, b.depth
          from best b join nodes t on t.id = b.node) where place <= 3""",
        "benchmark_scores": f"""{reached(all_nations, 1, 9500)}, l as (select 'nation:' || c_nationkey as root, 'customer:' || c_custkey as node, c_custkey % 3 <> 0 as expected from customer union all select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, s_suppkey % 3 <> 0 from supplier),
          m as (select l.*, b.node is not null as hit from l left join best b on b.root = l.root and b.node = l.node),
          c as (select coalesce(root, 'all') as root, count(*) filter (where expected and hit) as tp, count(*) filter (where expected and not hit) as fn, count(*) filter (where not expected and hit) as fp, count(*) filter (where not expected and not hit) as tn from m group by rollup (root))
          select *, coalesce(round(tp / nullif(tp + fn, 0)::double, 4), 1.0) as recall, coalesce(round(tp / nullif(tp + fp, 0)::double, 4), 1.0) as precision from c""",
        "catalog_merge": 'select p_type as "table", p_name as "column", first(p_brand order by p_partkey % 3, p_partkey, p_brand) as type from part group by 1, 2',
        "lens_titles": """with t as (select l_orderkey as g, list_sort(list(distinct p_brand)) as x from lineitem join part on l_partkey = p_partkey group by 1)
          select g as "group", len(x)::bigint as n, array_to_string(x[1:3], ', ') || case when len(x) > 3 then ' +' || (len(x) - 3) || ' more' else '' end as title from t""",
        "enclosing_blocks": """with s as (select page_id, string_split(html, chr(10)) as x from pages), l as (select page_id, unnest(x) as line, generate_subscripts(x, 1) - 1 as n from s),
          b as (select page_id, last_value(case when contains(line, '<p') or contains(line, '<div') then n end ignore nulls) over (partition by page_id order by n rows between unbounded preceding and current row) as block from l)
          select page_id, block::bigint as block, count(*) as n from b group by 1, 2""",
        "brier": f"select round(avg((p - actual) * (p - actual)), 4) as brier from {docs}",
        "calibration_curve": f"""with r as (select least(floor(p * 10), 9)::bigint as bucket, count(*) as n, avg(p) as mean, avg(actual) as accuracy from {docs} group by 1)
          select b.bucket, coalesce(n, 0) as n, round(mean, 4) as mean, round(accuracy, 4) as accuracy, round(abs(mean - accuracy), 4) as error, coalesce(n, 0) < 10 as too_few, case when coalesce(n, 0) < 10 then true else abs(mean - accuracy) <= 0.15 end as within
          from (select unnest(range(10)) as bucket) b left join r using (bucket)""",
        "clustering_gates": "select ari, q, ari >= 0.6 as ari_gate, q >= 0.3 as q_gate from (ARI) cross join (Q)",
        "bucket_labels": f"""select b.bucket, '[' || printf('%.1f', bucket / 10.0) || ', ' || printf('%.1f', (bucket + 1) / 10.0) || case when bucket = 9 then ']' else ')' end as label, coalesce(n, 0) as n
          from (select unnest(range(10)) as bucket) b left join (select least(floor(p * 10), 9)::bigint as bucket, count(*) as n from {docs} group by 1) using (bucket)""",
        "calibration_report": f"""with r as (select least(floor(p * 10), 9)::bigint as bucket, count(*) as n, avg(p) as mean, avg(actual) as accuracy from {docs} group by 1)
          select sum(n)::bigint as samples, count(*) filter (where n >= 10) as adequate, coalesce(bool_and(abs(mean - accuracy) <= 0.15) filter (where n >= 10), true) as passed, (select round(avg((p - actual) * (p - actual)), 4) from {docs}) as brier from r""",
        "type_thresholds": f"""with w as (select * from (values ('de', 0.8::double), ('en', 0.7), ('xx', 0.8)) v(kind, least)), s as (select lang as kind, count(*) as n, count(*) filter (where actual = 1) as tp, count(*) filter (where actual <> 1) as fp from {docs} group by lang),
          f as (select kind, n, coalesce(round(tp / nullif(tp + fp, 0)::double, 4), 0.0) as precision, {bound('-', 'greatest', '0.0')} as lower from s)
          select w.kind, least, coalesce(n, 0) as n, coalesce(precision, 0.0) as precision, coalesce(lower, 0.0) as lower, coalesce(precision, 0.0) >= least as passed from w left join f using (kind)""",
        "benchmark_verdict": "with scores as (SCORES), g as (select tp, fn, fp, recall, precision, coalesce(round(tp / nullif(tp + fn, 0)::double, 4), 1.0) as agreement from scores where root = 'all') select *, recall >= 0.9 as recall_gate, precision >= 0.85 as precision_gate, agreement >= 0.85 as agreement_gate, fn = 0 as no_miss_gate, true as told_gate, case when recall >= 0.9 and precision >= 0.85 and agreement >= 0.85 and fn = 0 then 'PASSED_VALIDATION' else 'FAILED_KILL_CHECK' end as verdict from g",
        "precision_by_type": f"""with s as (select lang as kind, count(*) as n, count(*) filter (where toxic = 0 and actual = 1) as tp, count(*) filter (where toxic = 0 and actual <> 1) as fp, count(*) filter (where toxic <> 0) as unknown from {docs} group by lang)
          select kind, n, tp, fp, unknown, coalesce(round(tp / nullif(tp + fp, 0)::double, 4), 0.0) as precision, round(tp / n::double, 4) as recall, {bound('-', 'greatest', '0.0')} as lower, {bound('+', 'least', '1.0')} as upper, {bound('-', 'greatest', '0.0')} >= 0.7 as passed from s""",
    }
    out["resolve_single_pass"] = out["resolve_target"].replace("select target, id, 4, seq", "select target, id, 3, seq")
    out["graph_metrics_three_places"] = out["graph_metrics"].replace("(dynamic * 20000 + dynamic + resolved) // nullif(2 * (dynamic + resolved), 0)", "(dynamic * 2000 + dynamic + resolved) // nullif(2 * (dynamic + resolved), 0) * 10")
    out["registered_graph"] = f"""with {CODE}, t as (select distinct 'table:' || {brand} as id, upper({brand}) as name from part where p_size < 25), u as (select 'table:' || {naive('w')} as id from code where flag = 'A' union select 'table:' || b from code where flag = 'R' union select 'table:unresolved' from code where flag not in ('A', 'R'))
      select id, 'table' as type, name, 'prisma' as source_system from t union all select distinct 'func:src/c' || c || '.py:order_' || o, 'function', 'order_' || o, 'python' from code
      union all select id, 'table', replace(id, 'table:', ''), 'inferred_from_code' from u where id not in (select id from t)"""
    out["clustering_gates"] = out["clustering_gates"].replace("ARI", out["adjusted_rand_index"]).replace("(Q)", f"({out['modularity_q']})")
    out["benchmark_verdict"] = out["benchmark_verdict"].replace("SCORES", out["benchmark_scores"])
    return out
