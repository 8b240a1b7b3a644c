"""Database references in source code, by language: functions, and what their bodies read, as edges.

files(path, content) is split into functions within each row (a function ends where the next one starts), and each
language's patterns are applied to the bodies; nothing is shuffled. Null contents count as empty. Line numbers start
at 1. Targets are `table:` and a lower-case name; calls with a variable instead of a query go to `table:unresolved`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import naive_plural, pluralize, sql_tables
from ..schema import BASE_C4, DYNAMIC, ORM_CALL, STATIC_SQL, STRUCTURAL, UNRESOLVED_ID


@dataclass(frozen=True)
class Language:
    """What functions look like, and the patterns of references: ORM calls as (pattern, group, name of the table), SQL literals, calls with a variable."""

    functions: tuple[str, ...]
    orm: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    sql: tuple[str, ...] = ()
    dynamic: tuple[str, ...] = ()
    whole: str = "<module>"
    not_functions: tuple[str, ...] = ()
    not_models: tuple[str, ...] = ()
    once: bool = False
    repository: str | None = None
    markers: tuple[str, ...] = field(default=())


# The patterns that decide which calls and literals count, and the words that do not.
_STATEMENT = r"(?:SELECT\s+[\s\S]*?\s+FROM|INSERT\s+INTO|UPDATE\s+[\s\S]*?\s+SET|DELETE\s+FROM)[\s\S]*?"
_BEGINS = r"(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE)"
LANGUAGES = {
    "python": Language(
        functions=(r"^\s*(?:async\s+)?def\s+([a-zA-Z0-9_]+)\s*\(",),
        orm=(
            (r"\b([A-Z][a-zA-Z0-9_]*)\.objects\.(?:filter|get|create|update|all|exclude|values|bulk_create|delete)\s*\(", naive_plural),
            (r"(?:session\.query|select)\s*\(\s*([A-Z][a-zA-Z0-9_]*)\s*[\),]", naive_plural),
        ),
        sql=(r"""(?i)["']{1,3}([^"'`]*""" + _STATEMENT + r""")["']{1,3}""",),
        dynamic=(r"\b(?:cursor\.execute|execute|raw)\s*\(\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*[,)]",),
    ),
    "javascript": Language(
        functions=(
            r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([a-zA-Z0-9_$]+)\s*\(",
            r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[a-zA-Z0-9_$]+)\s*=>",
            r"^\s*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z0-9_$]+)\s*=\s*(?:async\s+)?function\b",
            r"^\s*(?:async\s+)?([a-zA-Z0-9_$]+)\s*\([^)]*\)\s*\{",
        ),
        orm=(
            (r"\bknex\s*\(\s*['\"]([a-zA-Z0-9_]+)['\"]\s*\)", F.lower),
            (r"\bprisma\.([a-zA-Z0-9_]+)\.(?:findMany|findUnique|findFirst|create|createMany|update|updateMany|upsert|delete|deleteMany|count|aggregate|groupBy)\s*\(", pluralize),
            (r"\b([A-Z][a-zA-Z0-9_]+)\.(?:findAll|findOne|findByPk|findOrCreate|create|bulkCreate|update|destroy|count)\s*\(", pluralize),
        ),
        sql=(r"(?i)(?:\.query|\.raw|\.execute)\s*\(\s*[`'\"]([^`'\"]*" + _BEGINS + r"[^`'\"]*)[`'\"]", r"(?i)[`]([^`]*" + _BEGINS + r"[^`]*)[`]"),
        dynamic=(r"(?:\.query|\.execute|\.raw)\s*\(\s*([a-zA-Z_$][a-zA-Z0-9_$]*)\s*[,)]",),
        not_functions=("if", "for", "while", "switch", "catch", "return"),
        not_models=("Promise", "Object", "Array", "JSON", "Math", "Date", "String", "Number"),
        once=True,
    ),
    "go": Language(
        functions=(r"^\s*func\s+(?:\([^)]+\)\s+)?([a-zA-Z0-9_]+)\s*\(",),
        orm=(
            (r"\bdb\.Table\s*\(\s*[\"']([a-zA-Z0-9_]+)[\"']\s*\)", F.lower),
            (r"\b(?:db|tx)\.(?:Find|First|Take|Create|Save|Updates|Delete|Model)\s*\(\s*&(?:\w+\.)?([A-Z][a-zA-Z0-9_]*)", naive_plural),
        ),
        sql=(r"""(?i)[`'"]([^`'"]*""" + _STATEMENT + r""")[`'"]""",),
        whole="<package>",
    ),
    "java": Language(
        functions=(r"^\s*(?:public|protected|private)?\s*(?:static\s+)?(?:final\s+)?[\w<>\[\]\?]+\s+([a-zA-Z0-9_]+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?\s*\{",),
        sql=(r"""(?i)"([^"]*""" + _STATEMENT + r""")\"""",),
        markers=(r"""@Query\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']""",),
        whole="<class>",
        repository=r"interface\s+([a-zA-Z0-9_]+)\s+extends\s+(?:JpaRepository|CrudRepository|PagingAndSortingRepository)\s*<\s*([a-zA-Z0-9_]+)",
    ),
    "ruby": Language(
        functions=(r"^\s*def\s+([a-zA-Z0-9_!?]+)",),
        orm=((r"\b([A-Z][a-zA-Z0-9_]*)\.(?:where|find|find_by|create|create!|update|destroy_all|pluck|joins|includes)\s*[\(\s]", naive_plural),),
        sql=(r"""(?i)["']([^"']*""" + _STATEMENT + r""")["']""",),
        whole="<class>",
        not_models=("ActiveRecord", "ApplicationRecord", "JSON", "File", "Dir", "Time", "Date", "Integer"),
    ),
    "php": Language(
        functions=(r"^\s*(?:public|protected|private)?\s*(?:static\s+)?function\s+([a-zA-Z0-9_]+)\s*\(",),
        orm=(
            (r"\bDB::table\s*\(\s*[\"']([a-zA-Z0-9_]+)[\"']\s*\)", F.lower),
            (r"\b([A-Z][a-zA-Z0-9_]*)::(?:where|find|findOrFail|create|update|all|query|first)\s*\(", naive_plural),
        ),
        sql=(r"""(?i)["']([^"']*""" + _STATEMENT + r""")["']""",),
        whole="<file>",
        not_models=("DB", "Route", "Schema", "Auth", "Gate", "Validator", "Response", "Request", "App", "Config"),
    ),
}
UNIVERSAL_SQL = r"""(?i)["'`]([^"'`]*""" + _STATEMENT + r""")["'`]"""


def functions(files: DataFrame, language: Language) -> DataFrame:
    """(path, name, start, end, body) of each function; a file without any is one function with the language's name for it."""
    lines = F.split(F.coalesce("content", F.lit("")), "\n")
    taken = lambda line: F.filter(F.array(*[F.regexp_extract(line, p, 1) for p in language.functions]), lambda n: (n != "") & ~n.isin(*language.not_functions, ""))
    stripped = lambda line: F.trim(line)
    comment = lambda line: stripped(line).startswith("//") | stripped(line).startswith("/*")
    name = lambda line: F.when(F.lit(language.once) & comment(line), F.lit(None)).otherwise(F.get(taken(line), 0))
    rows = files.select("path", lines.alias("lines"))
    found = F.filter(F.transform("lines", lambda line, i: F.struct(name(line).alias("name"), (i + 1).alias("start"))), lambda f: f["name"].isNotNull())
    rows = rows.withColumn("found", found)
    whole = F.array(F.struct(F.lit(language.whole).alias("name"), F.lit(1).alias("start")))
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(whole))
    ends = F.transform("found", lambda f, i: F.struct(f["name"].alias("name"), f["start"].alias("start"), F.coalesce(F.get("found", i + 1)["start"] - 1, F.size("lines")).alias("end")))
    each = rows.select("path", "lines", F.explode(ends).alias("f"))
    return each.select("path", "f.name", "f.start", "f.end", F.array_join(F.slice("lines", F.col("f.start"), F.col("f.end") - F.col("f.start") + 1), "\n").alias("body"))


def _edges(found: Column, target: Callable[[Column], Column], kind: str, turn: int) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.lit(turn).alias("turn"), i.alias("place"), target(x).alias("target"), F.lit(kind).alias("type"), F.substring(x, 1, 80).alias("evidence")))


def _named(plural: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda model: F.concat(F.lit("table:"), plural(model))


def _literal(turn: Column) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(turn, i.alias("place"), F.concat(F.lit("table:"), x["t"]).alias("target"), F.lit(STATIC_SQL).alias("type"), F.substring(x["s"], 1, 80).alias("evidence"))


def references(files: DataFrame, language: str) -> DataFrame:
    """(source, target, type, c4, evidence, file, line): the edges of every function, and that to its file."""
    of = LANGUAGES[language]
    held = functions(files, of).withColumn("source", F.concat_ws(":", F.lit("func"), "path", "name"))
    every = lambda pattern: F.regexp_extract_all("body", F.lit(pattern), F.lit(1))
    parts = []
    for pattern, plural in of.orm:
        models = F.filter(every(pattern), lambda m: ~m.isin(*of.not_models, ""))
        parts.append(_edges(models, _named(plural), ORM_CALL, len(parts)))
    for pattern in (*of.markers, *of.sql):
        tables = F.flatten(F.transform(every(pattern), lambda s: F.transform(sql_tables(s), lambda t: F.struct(t.alias("t"), s.alias("s")))))
        turn = F.lit(len(parts)).alias("turn")
        parts.append(F.transform(tables, _literal(turn)))
    for pattern in of.dynamic:
        parts.append(_edges(every(pattern), lambda x: F.lit(UNRESOLVED_ID), DYNAMIC, len(parts)))
    found = F.concat(*parts)
    if of.once:  # of edges with one target, but for unresolved ones, the first of a function counts
        found = F.filter(found, lambda e, i: (e["type"] == DYNAMIC) | ~F.exists(F.slice(found, 1, i), lambda b: b["target"] == e["target"]))
    belongs = F.struct(F.lit(-1).alias("turn"), F.lit(0).alias("place"), F.concat(F.lit("file:"), "path").alias("target"), F.lit(STRUCTURAL).alias("type"), F.concat(F.lit("in "), "path", F.lit(":"), F.col("start").cast("string")).alias("evidence"))
    out = held.select("source", "path", "start", F.explode(F.concat(F.array(belongs), found)).alias("e"))
    if of.repository:
        out = out.unionByName(_repository(files, of.repository))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in BASE_C4.items() for x in pair]), F.col("e.type"))
    return out.select("source", "e.target", "e.type", weight.cast("long").alias("c4"), "e.evidence", F.col("path").alias("file"), F.col("start").cast("long").alias("line"))


def _repository(files: DataFrame, pattern: str) -> DataFrame:
    """The first repository interface of a file: a function that reads its entity's table."""
    text = F.coalesce("content", F.lit(""))
    found = files.select("path", *[F.regexp_extract(text, pattern, i).alias(n) for i, n in enumerate(("evidence", "name", "entity"))]).where("name <> ''")
    edge = lambda turn, target, kind, evidence: F.struct(F.lit(turn).alias("turn"), F.lit(0).alias("place"), target.alias("target"), F.lit(kind).alias("type"), evidence.alias("evidence"))
    edges = F.array(edge(-1, F.concat(F.lit("file:"), "path"), STRUCTURAL, F.lit("repository interface")), edge(0, F.concat(F.lit("table:"), naive_plural(F.col("entity"))), ORM_CALL, F.substring("evidence", 1, 80)))
    return found.select(F.concat_ws(":", F.lit("func"), "path", "name").alias("source"), "path", F.lit(1).alias("start"), F.explode(edges).alias("e"))


def literal_references(files: DataFrame) -> DataFrame:
    """(source, target, type, c4, evidence, file, line) of files of any other language: each literal with tables counts as a function `query_<n>`."""
    snippets = F.filter(F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(UNIVERSAL_SQL), F.lit(1)), lambda s: F.struct(s.alias("s"), sql_tables(s).alias("t"))), lambda x: F.size(x["t"]) > 0)
    each = files.select("path", F.posexplode(snippets).alias("i", "x")).withColumn("source", F.concat(F.lit("func:"), "path", F.lit(":query_"), (F.col("i") + 1).cast("string")))
    own = F.array(F.struct(F.concat(F.lit("file:"), "path").alias("target"), F.lit(STRUCTURAL).alias("type"), F.lit("belongs to").alias("evidence")))
    reads = F.transform("x.t", lambda t: F.struct(F.concat(F.lit("table:"), t).alias("target"), F.lit(STATIC_SQL).alias("type"), F.substring(F.col("x.s"), 1, 80).alias("evidence")))
    out = each.select("source", "path", F.explode(F.concat(own, reads)).alias("e"))
    weight = F.when(F.col("e.type") == STRUCTURAL, BASE_C4[STRUCTURAL]).otherwise(BASE_C4[STATIC_SQL])
    return out.select("source", "e.target", "e.type", weight.cast("long").alias("c4"), "e.evidence", F.col("path").alias("file"), F.lit(None).cast("long").alias("line"))
