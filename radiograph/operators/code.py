"""Database access of Python sources across files: models by a registry, queries by the constants that reach them.

files(path, content) is read a file a row: what a file declares and calls is extracted as facts, in column expressions,
and facts of different files meet in joins. Null contents count as empty. Functions are told by their `def` lines, as in
`extraction`; the text before the first one belongs to none and is not asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import clean_id, pluralize, snake_case
from ..functions.statements import walked_tables
from ..plans.lineage import cut, small
from ..schema import BASE_C4, DYNAMIC, ORM_CALL, STATIC_SQL, UNRESOLVED_ID
from .extraction import LANGUAGES, functions

_TEXT = r"""(?:[rRbBuU]{0,2})(?:\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+')"""
#: One literal or several side by side, in parentheses or not.
_CONSTANT = rf"(?:{_TEXT}|\(\s*{_TEXT}(?:\s+{_TEXT})*\s*\))(?:[ \t]+{_TEXT})*"
_ENDED = r"(?=[ \t]*(?:#[^\n]*)?(?:\n|\z|;))"
#: What follows one another in a function: an assignment that starts a line (its name, the constant if it is one), and a call (the constant, or the beginning of what is passed).
FACT = rf"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*(?::[^=\n]+)?=(?!=)[ \t]*(?:({_CONSTANT}){_ENDED})?|\.(execute|executemany)\s*\(\s*(?:({_CONSTANT})\s*(?=[,)])|(?=([^)\s][^\n]{{0,200}})))"


def _literal(text: Column) -> Column:
    """The text that a constant of one or several literals stands for, without resolving escapes."""
    each = F.regexp_extract_all(text, F.lit(_TEXT), F.lit(0))
    bare = F.transform(each, lambda t: F.regexp_replace(F.regexp_replace(t, r"^[rRbBuU]{0,2}(\"\"\"|'''|\"|')", ""), r"(\"\"\"|'''|\"|')\z", ""))
    return F.array_join(bare, "")


def facts(files: DataFrame) -> DataFrame:
    """(source, path, place, line, kind, name, argument, text) of every function: its assignments (`set`) and execute calls (`call`), in order.

    text is the constant that is assigned or passed, if it is one; argument names the kind of what is passed.
    """
    held = functions(files, LANGUAGES["python"]).where(F.col("name") != LANGUAGES["python"].whole).withColumn("source", F.concat_ws(":", F.lit("func"), "path", "name"))
    group = lambda i, name: F.regexp_extract_all("body", F.lit(FACT), F.lit(i)).alias(name)
    gaps = F.slice(F.split("body", FACT, -1), F.lit(1), F.size(group(0, "x"))).alias("gap")
    zipped = F.arrays_zip(group(0, "fact"), gaps, group(1, "name"), group(2, "given"), group(3, "method"), group(4, "passed"), group(5, "other"))
    rows = held.select("source", "path", "start", F.posexplode(zipped).alias("place", "x")).select("source", "path", "start", "place", "x.*")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = Window.partitionBy("source", "path", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("start") + F.coalesce(F.sum(breaks("gap") + breaks("fact")).over(before), F.lit(0)) + breaks("gap")
    is_call, text = F.col("method") != "", F.concat("given", "passed")
    name = F.when(is_call, F.regexp_extract("other", r"\A([A-Za-z_]\w*)\s*[,)]", 1)).otherwise(F.col("name"))
    return rows.select(
        "source", "path", "start", "place", line.cast("long").alias("line"), F.when(is_call, "call").otherwise("set").alias("kind"), name.alias("name"),
        F.when(is_call, _argument(F.col("other"), text != "")).alias("argument"), F.when(text != "", _literal(text)).alias("text"),
    )


def _argument(value: Column, constant: Column) -> Column:
    """What kind of expression the first argument of a call is."""
    operator = rf"\A(?:[fF])?(?:{_TEXT}|[A-Za-z_][\w.]*)\s*[+%]"
    return (
        F.when(constant, "Constant").when(value.rlike(operator), "BinOp").when(value.rlike(rf"\A[fF]?{_TEXT}\s*\."), "Call").when(value.rlike(r"\A(?:[rR]?[fF]|[fF][rR]?)[\"']"), "JoinedStr")
        .when(value.rlike(r"\A[A-Za-z_]\w*\s*[,)]"), "Name").when(value.rlike(r"\A[A-Za-z_]\w*(?:\.\w+)+\s*[,)]"), "Attribute").when(value.rlike(r"\A[A-Za-z_][\w.]*\s*\("), "Call").when(value.rlike(r"\A[A-Za-z_][\w.]*\s*\["), "Subscript").otherwise("Expr")
    )


def executed_queries(files: DataFrame, anywhere: bool = False) -> DataFrame:
    """(source, target, type, c4, argument, file, line) of each execute call: its query's tables, or the unresolved sink.

    A variable stands for what was last assigned to it before the call, if that is a constant; with `anywhere`, for the
    last constant that its function assigns to it at all. A constant without tables gives no edge. Of edges of a function
    with one target and line the first counts.
    """
    rows = facts(files)
    own = Window.partitionBy("source", "path", "start", "name").orderBy("place")
    given = F.when(F.col("kind") == "set", F.struct("text"))
    if anywhere:
        given = F.when((F.col("kind") == "set") & F.col("text").isNotNull(), F.struct("text"))
        own = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reaching = F.when(F.col("name") != "", F.last(given, ignorenulls=True).over(own))
    calls = rows.withColumn("text", F.coalesce("text", reaching["text"])).where("kind = 'call'")
    tables = F.when(F.col("text").isNotNull(), F.transform(walked_tables(F.col("text")), lambda t: F.concat(F.lit("table:"), t))).otherwise(F.array(F.lit(UNRESOLVED_ID)))
    each = calls.withColumn("tables", tables).select("source", "path", "line", "place", "argument", F.col("text").isNotNull().alias("static"), F.posexplode("tables").alias("nth", "target"))
    first = F.min(F.struct("place", "nth", "static", "argument")).alias("b")
    once = each.groupBy("source", "path", "target", "line").agg(first)
    kind = F.when(F.col("b.static"), STATIC_SQL).otherwise(DYNAMIC)
    weight = F.when(F.col("b.static"), BASE_C4[STATIC_SQL]).otherwise(BASE_C4[DYNAMIC]).cast("long")
    return once.select("source", "target", kind.alias("type"), weight.alias("c4"), F.col("b.argument").alias("argument"), F.col("path").alias("file"), "line")


#: A class line, what names its table, and any other line that has code: what is folded over a file.
_CLASS = r"^([ \t]*)class[ \t]+([A-Za-z_]\w*)"
_TABLE = r"^([ \t]*)(__tablename__|db_table)[ \t]*=[ \t]*[rRuU]?[\"']([^\"'\n]*)[\"'][ \t]*(?:#.*)?\r?$"
_CODE = r"^([ \t]*)[^\s#]"


def registry(files: DataFrame) -> DataFrame:
    """(model, table) of the classes of all files: `__tablename__` in a class, `db_table` in its `Meta`; the last definition by path and line wins.

    A fold over the lines keeps the classes that are open, by their indentation.
    """
    lines = F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    lines = F.filter(lines, lambda x: x["text"].rlike(_CODE))
    empty = F.struct(F.array().cast("array<struct<indent:int,name:string>>").alias("open"), F.array().cast("array<struct<model:string,table:string,line:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        text = x["text"]
        indent = F.length(F.regexp_extract(text, _CODE, 1))
        held = F.filter(s["open"], lambda c: c["indent"] < indent)
        name, key, table = F.regexp_extract(text, _CLASS, 2), F.regexp_extract(text, _TABLE, 2), F.regexp_extract(text, _TABLE, 3)
        last, outer = F.try_element_at(held, F.lit(-1)), F.try_element_at(held, F.lit(-2))
        model = F.when(key == "__tablename__", last["name"]).when((key == "db_table") & (last["name"] == "Meta"), outer["name"])
        found = F.when(model.isNotNull(), F.concat(s["found"], F.array(F.struct(model.alias("model"), F.lower(table).alias("table"), x["line"].alias("line"))))).otherwise(s["found"])
        return F.struct(F.when(name != "", F.concat(held, F.array(F.struct(indent.alias("indent"), name.alias("name"))))).otherwise(held).alias("open"), found.alias("found"))

    each = files.select("path", F.explode(F.aggregate(lines, empty, step, lambda s: s["found"])).alias("m"))
    return each.groupBy(F.col("m.model").alias("model")).agg(F.max(F.struct("path", F.col("m.line").alias("line"), F.col("m.table").alias("table")))["table"].alias("table"))


#: Calls that name models: session.query(A, b.C), select(A, b.C), A.objects ...
_QUERY, _SELECT, _OBJECTS = r"\.query\s*\(([^()\n]*)", r"(?<![\w.])select\s*\(([^()\n]*)", r"(?<![\w.])([A-Z]\w*)\.objects\b"


def model_uses(files: DataFrame) -> DataFrame:
    """(source, model, orm, file, line) of each function's calls that name a model; one row for each model and line."""
    held = functions(files, LANGUAGES["python"]).where(F.col("name") != LANGUAGES["python"].whole).withColumn("source", F.concat_ws(":", F.lit("func"), "path", "name"))
    lines = held.select("source", "path", "start", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    passed = lambda pattern: F.flatten(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda a: F.regexp_extract_all(a, F.lit(r"(?:\A|,)\s*(?:\w+\.)*([A-Z]\w*)\s*(?=,|\z)"), F.lit(1))))
    named = lambda models, orm: F.transform(models, lambda m: F.struct(m.alias("model"), F.lit(orm).alias("orm")))
    every = F.concat(named(passed(_QUERY), "sqlalchemy"), named(passed(_SELECT), "sqlalchemy"), named(F.regexp_extract_all("text", F.lit(_OBJECTS), F.lit(1)), "django"))
    rows = lines.where(F.col("text").rlike("query|select|objects")).select("source", "path", (F.col("start") + F.col("i")).cast("long").alias("line"), F.explode(every).alias("u"))
    return rows.groupBy("source", F.col("path").alias("file"), "line", "u.model").agg(F.min("u.orm").alias("orm"))


def model_references(files: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(source, target, type, c4, model, orm, file, line): the tables of the models that functions use, wherever those are declared.

    A model's table is what the registry says, else the plural of its name in snake case. With tables(id, name, seq), a
    bare name means its first table and a qualified one itself; others stand for themselves.
    """
    known = small(cut(registry(files)))
    uses = model_uses(files).join(known, "model", "left")
    raw = F.coalesce("table", pluralize(snake_case(F.col("model"))))
    uses = uses.withColumn("raw", raw)
    target = F.concat(F.lit("table:"), "raw")
    if tables is not None:
        by_name = tables.groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("seq", "id"))["id"].alias("id")).select("key", "id", F.lit(1).alias("rank"))
        by_id = tables.groupBy(clean_id(F.col("id")).alias("key")).agg(F.max(F.struct("seq", "id"))["id"].alias("id")).select("key", "id", F.lit(0).alias("rank"))
        lookup = small(cut(by_name.unionByName(by_id).groupBy("key").agg(F.min(F.struct("rank", "id"))["id"].alias("id"))))
        uses = uses.join(lookup, F.lower("raw") == F.col("key"), "left")
        target = F.coalesce("id", F.concat(F.lit("table:"), "raw"))
    out = uses.select("source", target.alias("target"), "model", "orm", "file", "line")
    once = out.groupBy("source", "target", "file", "line").agg(F.min(F.struct("model", "orm")).alias("b"))
    return once.select("source", "target", F.lit(ORM_CALL).alias("type"), F.lit(BASE_C4[ORM_CALL]).cast("long").alias("c4"), "b.model", "b.orm", "file", "line")
