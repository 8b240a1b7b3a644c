"""Queries over SQL statements and Python sources, with SQL that knows their results from the rows that the texts were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statements import walked_tables
from ..operators import code, extraction
from ..sources.code import FORMS, form_files, model_files, model_tables, query_files, statements
from .sql import naive, plural


def _walked(s: SparkSession, d: str) -> DataFrame:
    found = statements(s, d).select("o_orderkey", F.posexplode(walked_tables(F.col("statement"))).alias("place", "table_name"))
    return found.select("o_orderkey", F.col("place").cast("long").alias("place"), "table_name")


def _executed(anywhere: bool):
    return lambda s, d: code.executed_queries(query_files(s, d), anywhere).select("source", "target", "type", "c4", "argument", "line")


def _models(s: SparkSession, d: str) -> DataFrame:
    return code.model_references(model_files(s, d), model_tables(s, d)).select("source", "target", "model", "orm", "line")


def _every(language: str):
    """Every edge that a language's patterns find in files that hold each kind of line, counted."""
    return lambda s, d: extraction.references(form_files(s, d, language), language).groupBy("source", "target", "type", "c4").agg(F.count("*").alias("n"))


def queries() -> dict:
    return {
        **{f"extract_every_{language}": _every(language) for language in FORMS},
        "sql_token_walk": _walked,
        "constant_queries": _executed(False),
        "constant_queries_anywhere": _executed(True),
        "model_registry": lambda s, d: code.registry(model_files(s, d)),
        "model_references": _models,
    }


_BRAND = "lower(replace(p_brand, '#', ''))"
_ITEMS = f"""lines as (select l_orderkey as o, l_linenumber as k, {_BRAND} as b, lower(string_split(p_name, ' ')[2]) as w from lineitem join part on l_partkey = p_partkey)"""
#: Each line of a function with its text's beginning, its place in it, and its line in the file.
_CALLS = f"""{_ITEMS}, owned as (select o_custkey as c, o_orderkey as o, k % 6 as f, b, w, case when k is null then 0 when k % 6 = 4 then 2 else 1 end as height,
    row_number() over (partition by o_orderkey order by k, b, w) as i from orders left join lines on o = o_orderkey),
placed as (select *, 1 + sum(height + (i = 1)::int) over (partition by c order by o, i) - height + 1 as line from owned),
given as (select *, last_value(case when f = 0 then b when f = 2 then '' end ignore nulls) over (partition by o order by i rows between unbounded preceding and 1 preceding) as near,
    first(b order by i desc) filter (where f = 0) over (partition by o) as any_ from placed)"""


def _called(which: str) -> str:
    func = "'func:src/q' || c || '.py:order_' || o as source"
    sink = "'table:unresolved', 'dynamic_unresolved', 1500::bigint"
    return f"""with {_CALLS.replace("first(b order by i desc) filter (where f = 0) over (partition by o)", "(select first(b order by i desc) from placed p where p.o = placed.o and p.f = 0)")}
select {func}, 'table:' || {which} as target, 'static_sql_string' as type, 9600::bigint as c4, 'Name' as argument, line::bigint as line from given where f = 1 and {which} <> ''
union all select {func}, {sink}, 'Name', line from given where f = 1 and coalesce({which}, '') = ''
union all select {func}, {sink}, 'JoinedStr', line from given where f = 3 union all select {func}, {sink}, 'BinOp', line from given where f = 5
union all select {func}, unnest(['table:shop.' || b, 'table:' || w]), 'static_sql_string', 9600, 'Constant', line from given where f = 4"""


def _found(language: str) -> str:
    """The edges that FORMS says are in a language's files, from the rows that the files were made of."""
    extension, _, headers, forms = FORMS[language]
    kinds = {"b": ("b", "static_sql_string"), "b_y": ("b || '_y'", "static_sql_string"), "m": (naive("w"), "orm_call"), "p": (plural("w"), "orm_call"), "?": ("'unresolved'", "dynamic_unresolved")}
    direct = {"knex(", "db.Table(", "DB::table("}  # tables that calls name themselves
    cases = []
    for i, (text, found) in enumerate(forms):
        edges = [kinds[f] for f in found.split()]
        edges = [(t, "orm_call") if any(x in text for x in direct) else (t, k) for t, k in edges]
        cases.append(f"when {i} then [" + ", ".join(f"{{'t': {t}, 'k': '{k}'}}" for t, k in edges) + "]" if edges else f"when {i} then []")
    name = "'order_' || o" + (" || case when o % 2 = 1 then '?' else '' end" if language == "ruby" else "")
    n, kind, by = "count(*)", "x.k", ", x.k"
    if extraction.LANGUAGES[language].once:  # of a function's edges to one table the first counts, calls of models before literals
        n, kind, by = "case when x.t = 'unresolved' then count(*) else 1 end", "case when bool_or(x.k = 'orm_call') then 'orm_call' else any_value(x.k) end", ""
    return f"""with lines as (select l_orderkey as o, (l_partkey + l_linenumber) % {len(forms)} as f, {_BRAND} as b, lower(string_split(p_name, ' ')[2]) as w from lineitem join part on l_partkey = p_partkey),
      owned as (select o_custkey as c, o_orderkey as o, f, b, w from orders left join lines on o = o_orderkey),
      found as (select c, o, unnest(case f {' '.join(cases)} end) as x from owned),
      e as (select 'func:src/f' || c || '.{extension}:' || {name} as source, 'table:' || x.t as target, {kind} as type, {n} as n from found group by c, o, x.t{by}
        union all select distinct 'func:src/f' || c || '.{extension}:' || {name}, 'file:src/f' || c || '.{extension}', 'structural_belongs_to', 1 from owned)
      select source, target, type, (case type when 'orm_call' then 9800 when 'static_sql_string' then 9600 when 'dynamic_unresolved' then 1500 else 10000 end)::bigint as c4, n from e"""


_MODELS = """declared as (select p_partkey as p, p_partkey % 3 as f, upper(string_split(p_name, ' ')[2][1]) || lower(string_split(p_name, ' ')[2][2:]) || upper(p_name[1]) || lower(string_split(p_name, ' ')[1][2:]) as m,
    lower(string_split(p_name, ' ')[2]) || '_' || lower(string_split(p_name, ' ')[1]) as snake, lower(string_split(p_name, ' ')[1] || '_' || replace(p_brand, '#', '')) as t, lower(string_split(p_type, ' ')[1]) as schema from part),
registered as (select m as model, first(t order by 'models/p' || p || '.py' desc) as t from declared where f < 2 group by m)"""
SQL = {
    **{f"extract_every_{language}": _found(language) for language in FORMS},
    "sql_token_walk": f"""with {_ITEMS}, owned as (select o, row_number() over (partition by o order by k, case when k % 5 = 4 then b || '_' else b end) as i, case k % 5 when 0 then [b] when 1 then ['shop.' || b] when 2 then [b] when 3 then ['other.' || b, b] else [b || '_x', b || '_y'] end as names from lines),
      s as (select o_orderkey as o, 1000000 as i, [lower(c_mktsegment), lower(c_mktsegment) || '_log'] as names from orders join customer on o_custkey = c_custkey),
      e as (select o, i, unnest(names) as name, generate_subscripts(names, 1) as j from (select o, i, names from owned union all select * from s)), f as (select o, name, min(i * 10 + j) as pos from e group by all)
      select o as o_orderkey, (row_number() over (partition by o order by pos) - 1)::bigint as place, name as table_name from f where o in (select o from s)""",
    "constant_queries": _called("near"),
    "constant_queries_anywhere": _called("any_"),
    "model_registry": f"""with {_MODELS} select model, t as "table" from registered""",
    "model_references": f"""with {_MODELS}, known as (select t, first('table:' || schema || '.' || t order by p) as id from declared where p % 2 = 0 group by t),
      used as (select o_custkey as c, o_orderkey as o, l_linenumber % 3 as f, m, snake, row_number() over (partition by o_orderkey order by l_linenumber, case l_linenumber % 3 when 0 then m else m end) as i, l_linenumber is not null as is_line
        from orders left join (select * from lineitem join declared on l_partkey = p) on l_orderkey = o_orderkey),
      placed as (select *, 1 + sum(is_line::int + (i = 1)::int) over (partition by c order by o, i) as line from used)
      select 'func:src/m' || c || '.py:order_' || o as source, coalesce(k.id, 'table:' || coalesce(r.t, {plural('snake')})) as target, m as model, case when f = 2 then 'django' else 'sqlalchemy' end as orm, line::bigint as line
      from placed left join registered r on r.model = m left join known k on k.t = coalesce(r.t, {plural('snake')}) where is_line""",
}
