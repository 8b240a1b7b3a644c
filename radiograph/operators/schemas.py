"""Tables, columns and foreign keys declared in schema texts: DDL, Prisma models, Rails schemas.

Each parser takes files(path, content) and gives (columns, keys): columns(path, table, column, type, primary_key,
nullable), keys(path, table, column, target, target_column). All of it happens within a file's row. Null contents
declare nothing.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import naive_plural

#: Marks of a comma and of the parentheses at the first level.
_COMMA, _OPEN, _CLOSE = "\x01", "\x02", "\x03"
#: Nested parentheses that a pattern follows within the items of a statement; deeper ones are counted by a fold.
LEVELS = 12


def _run(stops: str, name: str, nested: str = "") -> str:
    """A token that isn't among `stops`: what lies between, literals, quoted names and bodies whole, a quote without its end."""
    quoted = rf"""'[^']*+(?:''[^']*+)*+'|"[^"]*+"|`[^`]*+`|\$(?<{name}>\w*)\$[\s\S]*?\$\k<{name}>\$"""
    return rf"""(?:[^{stops}'"`$]+|{quoted}|['"`$]{"|" + nested if nested else ""})"""


def _nested(levels: int) -> str:
    """Balanced parentheses of up to so many levels."""
    out = ""
    for i in range(levels):
        out = rf"\({_run('()', f'q{i}', out)}*+\)"
    return out


# Every run of tokens is possessive, so that a text is read once.
STATEMENT = _run(";", "q") + "++"
HEAD = r"\A" + _run("(", "q") + "*+"
BODY = rf"\A{_run('(', 'head')}*+\(({_run('()', 'body', _nested(LEVELS))}*+)\)"  # its second group
ITEM = _run("(),", "item", _nested(LEVELS)) + "++"
TOKEN = rf"[(),]|{_run('(),', 'q')}++"
CREATE_TABLE = r"(?i)\bcreate\s+(?:unlogged\s+|temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\z"
CREATE_PARTITION = r"(?i)\bcreate\s+(?:unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s+partition\s+of\s+([\w.\"`]+)"
CREATE_VIEW = r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?view\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)"
NAMED = r"(?i)^\s*constraint\s+([\w\"`]+)\s"
ADD_KEY = r"(?i)\balter\s+table\s+(?:only\s+)?([\w.\"`]+)\s+add\s+(?:constraint\s+[\w\"`]+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?"
TABLE_KEY = r"(?i)^(?:constraint\s+[\w\"`]+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?"
COLUMN_KEY = r"(?i)\breferences\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?"
PRIMARY = r"(?i)^(?:constraint\s+[\w\"`]+\s+)?primary\s+key\s*\(([^)]*)\)"
OTHER = r"(?i)^(?:constraint|primary\s+key|unique|check|foreign\s+key|exclude|like|index|key)\b"
# What models, Rails tables and Rails keys look like.
MODEL = r"model\s+([a-zA-Z0-9_]+)\s*\{([\s\S]*?)\}"
RAILS_TABLE = r"create_table\s+[\"']([a-zA-Z0-9_]+)[\"'][\s\S]*?do\s*\|[a-zA-Z0-9_]+\|([\s\S]*?)\bend\b"
RAILS_KEY = r"add_foreign_key\s+[\"']([a-zA-Z0-9_]+)[\"'],\s*[\"']([a-zA-Z0-9_]+)[\"']"


def _pairs(text: Column, pattern: str, *groups: int) -> Column:
    """The groups of every match, as structs g0, g1, ..."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)])


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _plain(name: Column, qualified: bool) -> Column:
    bare = F.lower(F.regexp_replace(name, "[\"`]", ""))
    return F.regexp_replace(bare, r"^public\.", "") if qualified else F.element_at(F.split(bare, r"\."), -1)


def _names(listed: Column) -> Column:
    return F.transform(F.split(listed, ","), lambda c: F.lower(F.regexp_replace(_trimmed(c), "[\"`]", "")))


def _exploded_keys(rows: DataFrame, qualified: bool) -> DataFrame:
    """rows(path, table, own, target, theirs) of lists of columns as one row for each pair; without a list the target's id."""
    theirs = F.when(F.trim("theirs") == "", F.transform(_names(F.col("own")), lambda c: F.lit("id"))).otherwise(_names(F.col("theirs")))
    each = rows.select("path", "table", _plain(F.col("target"), qualified).alias("target"), F.explode(F.arrays_zip(_names(F.col("own")).alias("o"), theirs.alias("t"))).alias("x"))
    return each.select("path", "table", F.col("x.o").alias("column"), "target", F.col("x.t").alias("target_column")).where("column <> ''")


def statements(files: DataFrame) -> DataFrame:
    """(path, place, statement) of each statement of files(path, content).

    Literals, quoted names and quoted bodies are single tokens, in which nothing ends a statement; comments don't count.
    """
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("text"))
    for marks, pattern in ((("/*",), r"/\*[\s\S]*?\*/"), (("--",), r"--[^\n]*"), (("\x01", "\x02", "\x03", "\x04"), r"[\x01-\x04]")):
        held = reduce(or_, [F.contains("text", F.lit(m)) for m in marks])
        rows = rows.select("path", F.when(held, F.regexp_replace("text", pattern, "")).otherwise(F.col("text")).alias("text"))
    return rows.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(STATEMENT), F.lit(0))).alias("place", "statement"))


def _head(statement: str) -> Column:
    """What stands before a statement's first parenthesis."""
    return F.regexp_extract(statement, HEAD, 0)


def _counted(statement: str) -> Column:
    """What a statement's first parentheses hold, divided at their commas, whatever their depth is and whether or not they are closed.

    A fold over the tokens counts the depth and marks the first level. It copies what it has read for each token, so it is
    left to what patterns don't follow.
    """

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"]
        deeper = F.when(t == "(", depth + 1).when(t == ")", F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        mark = F.when(depth > 1, t).when((t == "(") & (depth == 0), _OPEN).when((t == ")") & (depth == 1), _CLOSE).when((t == ",") & (depth == 1), _COMMA).otherwise(t)
        return F.struct(deeper.alias("depth"), F.concat(s["text"], mark).alias("text"))

    def parts(s: Column) -> Column:
        rest = F.substring(s["text"], F.length(F.substring_index(s["text"], _OPEN, 1)) + 2, F.length(s["text"]))
        return F.split(F.substring_index(rest, _CLOSE, 1), _COMMA)

    return F.aggregate(F.regexp_extract_all(statement, F.lit(TOKEN), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit("").alias("text")), step, parts)


def ddl_objects(files: DataFrame, qualified: bool = False) -> DataFrame:
    """(path, name, kind, parent): the tables, partitions (with their parent) and views that statements create; a name's first statement counts."""
    found = lambda kind, pattern, parent: F.array(F.struct(F.lit(kind).alias("kind"), _plain(F.regexp_extract("head", pattern, 1), qualified).alias("name"), parent.alias("parent")))
    parent, none = _plain(F.regexp_extract("head", CREATE_PARTITION, 2), qualified), F.lit(None).cast("string")
    kinds = F.when(F.col("head").rlike(CREATE_VIEW), found("view", CREATE_VIEW, none)).when(F.col("head").rlike(CREATE_PARTITION), found("partition", CREATE_PARTITION, parent)).when(F.col("head").rlike(CREATE_TABLE), found("table", CREATE_TABLE, none))
    named = statements(files).select("path", "place", _head("statement").alias("head")).select("path", "place", F.inline(kinds))
    return named.groupBy("path", "name").agg(F.min(F.struct("place", "kind", "parent")).alias("b")).select("path", "name", "b.kind", "b.parent")


def _items(files: DataFrame, qualified: bool) -> DataFrame:
    """(path, table, primary, item, added): the items of every CREATE TABLE, with its primary key's columns, and every ALTER TABLE that adds a key, whole."""
    created = statements(files).select("path", F.regexp_extract(_head("statement"), CREATE_TABLE, 1).alias("created"), "statement")
    body = created.select("path", "created", "statement", F.when(F.col("created") != "", F.regexp_extract("statement", BODY, 2)).alias("body"))
    divided = F.when(F.col("body") != "", F.regexp_extract_all("body", F.lit(ITEM), F.lit(0))).otherwise(_counted("statement"))
    items = F.when(F.col("created") != "", F.transform(divided, _trimmed)).when(F.col("statement").rlike(ADD_KEY), F.array("statement"))
    name = F.when(F.col("created") != "", F.col("created")).otherwise(F.regexp_extract("statement", ADD_KEY, 1))
    rows = body.select("path", "created", _plain(name, qualified).alias("table"), items.alias("items"))
    added, nothing = F.col("created") == "", F.array().cast("array<string>")
    primary = F.flatten(F.transform("items", lambda i: F.when(i.rlike(PRIMARY), _names(F.regexp_extract(i, PRIMARY, 1))).otherwise(nothing)))
    # An outer explode, as from an inner one Spark infers a filter that would make all items twice.
    return rows.select("path", "table", F.when(added, nothing).otherwise(primary).alias("primary"), added.alias("added"), F.explode_outer("items").alias("item")).where("item is not null")


def _keys(items: DataFrame) -> DataFrame:
    """(path, table, constraint, apart, own, target, theirs): keys of columns, and those that stand apart from them, with lists of columns as they are written."""
    at = lambda pattern, group: F.regexp_extract("item", pattern, group)
    added, listed, inline = F.col("added"), F.col("item").rlike(TABLE_KEY), _is_column() & F.col("item").rlike(COLUMN_KEY)
    held = items.where(added | listed | inline).withColumn("listed", listed)
    chosen = lambda a, b, c: F.when(added, a).when(F.col("listed"), b).otherwise(c)
    named = chosen(at(r"(?i)\badd\s+constraint\s+([\w\"`]+)\s", 1), at(NAMED, 1), F.lit(""))
    parts = [chosen(at(ADD_KEY, 2), at(TABLE_KEY, 1), _column_name()), chosen(at(ADD_KEY, 3), at(TABLE_KEY, 2), at(COLUMN_KEY, 1)), chosen(at(ADD_KEY, 4), at(TABLE_KEY, 3), at(COLUMN_KEY, 2))]
    return held.select("path", "table", named.alias("constraint"), (added | F.col("listed")).alias("apart"), *[c.alias(n) for c, n in zip(parts, ("own", "target", "theirs"), strict=True)])


def _is_column() -> Column:
    return (F.col("item") != "") & ~F.col("item").rlike(OTHER)


def _column_name() -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract("item", r"^\s*(\S+)", 1), "[\"`]", ""))


def ddl(files: DataFrame, qualified: bool = False) -> tuple[DataFrame, DataFrame]:
    """CREATE TABLE and ALTER TABLE ... ADD FOREIGN KEY; comments don't count. With `qualified`, schemas but `public` stay in the names."""
    every = _items(files, qualified)
    items = every.where("not added")
    kind = F.lower(F.trim(F.regexp_extract("item", r"(?i)^\s*\S+\s+([a-z][\w ]*?(?:\([^)]*\))?(?:\[\])?)(?=\s+(?:not|null|primary|references|default|unique|check|constraint|collate|generated)\b|\s*$)", 1)))
    is_primary = F.col("item").rlike(r"(?i)\bprimary\s+key\b") | F.array_contains("primary", _column_name())
    columns = items.where(_is_column()).select("path", "table", _column_name().alias("column"), kind.alias("type"), is_primary.alias("primary_key"), (~is_primary & ~F.col("item").rlike(r"(?i)\bnot\s+null\b")).alias("nullable"))
    return columns, _exploded_keys(_keys(every), qualified)


def ddl_constraints(files: DataFrame, qualified: bool = False) -> DataFrame:
    """(path, table, constraint, columns, target, target_columns): one row for each foreign key, however many columns it has.

    A key without a name is called `fk_<table>_<column>`, or `fk_<table>_<target>` where it stands apart from its columns.
    """
    rows = _keys(_items(files, qualified))
    target, own = _plain(F.col("target"), qualified), _names(F.col("own"))
    theirs = F.when(F.trim("theirs") == "", F.transform(own, lambda c: F.lit("id"))).otherwise(_names(F.col("theirs")))
    called = F.when(F.col("constraint") != "", F.lower(F.regexp_replace("constraint", "[\"`]", ""))).otherwise(F.concat(F.lit("fk_"), "table", F.lit("_"), F.when(F.col("apart"), target).otherwise(F.element_at(own, 1))))
    return rows.select("path", "table", called.alias("constraint"), own.alias("columns"), target.alias("target"), theirs.alias("target_columns"))


def prisma(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models; a relation's target is the plural of its model, whatever that one maps to."""
    models = files.select("path", F.explode(_pairs(F.coalesce("content", F.lit("")), MODEL, 1, 2)).alias("x"))
    mapped = F.regexp_extract("x.g1", r"(?i)@@map\s*\(\s*[\"']([^\"']+)[\"']\s*\)", 1)
    table = F.lower(F.when(mapped != "", mapped).otherwise(naive_plural(F.col("x.g0"))))
    lines = models.select("path", table.alias("table"), F.explode(F.transform(F.split("x.g1", "\n"), lambda i: _trimmed(i))).alias("line"))
    words = F.split("line", r"\s+")
    fields = lines.where(~F.col("line").startswith("//") & ~F.col("line").startswith("@@") & (F.size(words) >= 2)).withColumn("kind", F.get(words, 1))
    columns = fields.select("path", "table", F.get(words, 0).alias("column"), F.col("kind").alias("type"), F.col("line").contains("@id").alias("primary_key"), F.col("kind").endswith("?").alias("nullable"))
    relation = F.regexp_extract("line", r"(?i)@relation\s*\(([^)]*)\)", 1)
    own, theirs = (F.trim(F.regexp_extract(relation, rf"(?i){w}\s*:\s*\[([^\]]+)\]", 1)) for w in ("fields", "references"))
    target = naive_plural(F.regexp_replace("kind", r"[?\[\]]", ""))
    keys = fields.where(own != "").select("path", "table", own.alias("column"), target.alias("target"), F.when(theirs != "", theirs).otherwise("id").alias("target_column"))
    return columns, keys


def rails(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """create_table blocks (each with an id; a column `x_id` refers to `xs`) and add_foreign_key, unless the pair is there already."""
    text = F.coalesce("content", F.lit(""))
    tables = files.select("path", F.explode(_pairs(text, RAILS_TABLE, 1, 2)).alias("x")).select("path", F.lower("x.g0").alias("table"), F.col("x.g1").alias("body"))
    lines = tables.select("path", "table", F.explode(F.split("body", "\n")).alias("line"))
    pattern = r"(?i)t\.([a-zA-Z0-9_]+)\s+[\"']([a-zA-Z0-9_]+)[\"']"
    held = lines.select("path", "table", F.regexp_extract("line", pattern, 2).alias("column"), F.upper(F.regexp_extract("line", pattern, 1)).alias("type"), F.lit(False).alias("primary_key"), (~F.col("line").contains("null: false")).alias("nullable")).where("column <> ''")
    ids = tables.select("path", "table", F.lit("id").alias("column"), F.lit("INTEGER").alias("type"), F.lit(True).alias("primary_key"), F.lit(False).alias("nullable"))
    implied = held.where(F.col("column").endswith("_id")).select("path", "table", "column", F.lower(F.concat(F.expr("left(column, length(column) - 3)"), F.lit("s"))).alias("target"), F.lit("id").alias("target_column"))
    added = files.select("path", F.explode(_pairs(text, RAILS_KEY, 1, 2)).alias("x")).select("path", F.lower("x.g0").alias("table"), F.lower("x.g1").alias("target"))
    fresh = added.distinct().join(implied.select("path", "table", "target").distinct(), ["path", "table", "target"], "left_anti")
    fresh = fresh.select("path", "table", F.concat(F.expr("left(target, length(target) - 1)"), F.lit("_id")).alias("column"), "target", F.lit("id").alias("target_column"))
    return ids.unionByName(held), implied.unionByName(fresh)
