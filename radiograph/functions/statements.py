"""Tables that SQL statements refer to, by a walk over their tokens: a stack machine as a fold, in column expressions.

A table's name may follow FROM, JOIN, INTO, UPDATE or TABLE, and a comma after such a name. Parentheses save the state and
restore it: what opens where a name may stand is a subquery or a nested list of tables, what opens elsewhere is a call, a
list of columns or a condition, in which FROM counts again (a subquery), but not in calls whose arguments it separates.
Comments are no tokens, and what stands in a literal is not read. Names keep their qualifiers; a common table expression
counts as the table that it is named like.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a table's name may follow, and words that are no table even there.
INTRODUCING = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE")
NOT_TABLES = (
    "SELECT", "SET", "WHERE", "VALUES", "ORDER", "GROUP", "HAVING", "LIMIT", "OFFSET", "THE", "A", "AN", "THIS", "THAT", "THESE", "THOSE", "BATCH", "ALL", "ANY", "EACH", "EVERY", "ONE", "ROW", "ROWS",
    "DATA", "IS", "ARE", "WAS", "WERE", "NOT", "AND", "OR", "IN", "ON", "BY", "FOR", "WITH", "AS", "AT", "TO", "FROM",
)
#: Words between an introducing word and its name, words after which a list of tables goes on, and words that end it.
BETWEEN = ("ONLY", "LATERAL", "IF", "EXISTS", "TEMPORARY", "OVERWRITE", "IGNORE")
ENDING = ("SELECT", "SET", "WHERE", "VALUES", "VALUE", "ORDER", "GROUP", "HAVING", "LIMIT", "OFFSET", "UNION", "EXCEPT", "INTERSECT", "RETURNING", "WINDOW", "FETCH", "FOR", "DEFAULT", "WHEN")
#: Calls with FROM between their arguments, and words before which FROM or UPDATE introduces no table.
SEPARATED = ("EXTRACT", "SUBSTRING", "TRIM", "OVERLAY", "POSITION")
NO_UPDATE = ("FOR", "ON", "DO", "KEY")

_PART = r"""(?:[A-Za-z_\u0080-\uffff][\w$#\u0080-\uffff]*+|"[^"]*+"|`[^`]*+`|\[[^\]\[]*+\])"""
#: Comments, names with their qualifiers, literals, numbers, and single characters of the rest.
TOKEN = rf"--[^\n]*|/\*[\s\S]*?\*/|{_PART}(?:\s*\.\s*(?:{_PART}|\*))*|'[^']*+(?:''[^']*+)*+'|[0-9][\w.]*|[^\s\w]"

_IDLE, _AWAITED, _LISTED, _SEPARATING = 0, 1, 2, 3


def _is(word: Column, of: tuple[str, ...]) -> Column:
    return word.isin(*of)


def walked_tables(sql: Column) -> Column:
    """The distinct lower-case tables of a text of statements, with their qualifiers, in the order of their first mention."""
    tokens = F.filter(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*"))
    strings, ints = F.array().cast("array<string>"), F.array().cast("array<int>")
    start = F.struct(F.lit(_IDLE).alias("mode"), ints.alias("stack"), F.lit("").alias("before"), strings.alias("found"))

    def step(s: Column, token: Column) -> Column:
        word, mode, before = F.upper(token), s["mode"], s["before"]
        opens, closes, literal = token == "(", token == ")", token.startswith("'")
        introduces = _is(word, INTRODUCING) & (mode != _SEPARATING) & ~((word == "FROM") & (before == "DISTINCT")) & ~((word == "UPDATE") & _is(before, NO_UPDATE))
        is_name = token.rlike(r"""^[A-Za-z_"`\['\u0080-\uffff]""") & ~_is(word, BETWEEN)
        taken = (mode == _AWAITED) & is_name & ~_is(word, INTRODUCING) & ~_is(word, NOT_TABLES)
        name = F.lower(F.regexp_replace(F.when(literal, F.regexp_extract(token, r"^'\s*([^\s',;]*)", 1)).otherwise(token), r"[\"`\[\]\s]", ""))
        saved = F.when(mode == _AWAITED, _LISTED).otherwise(mode)
        inside = F.when(mode == _AWAITED, _AWAITED).when(_is(before, SEPARATED), _SEPARATING).otherwise(_IDLE)
        restored = F.coalesce(F.element_at(F.concat(F.array(F.lit(_IDLE)), s["stack"]), -1), F.lit(_IDLE))
        follows = (
            F.when(opens, inside).when(closes, restored).when(introduces, _AWAITED).when(taken, _LISTED)
            .when(_is(word, BETWEEN) | ((word == "NOT") & (before == "IF")), mode)
            .when(token == ";", _IDLE).when((token == ",") & (mode == _LISTED), _AWAITED)
            .when(mode == _AWAITED, _IDLE).when((mode == _LISTED) & _is(word, ENDING), _IDLE).otherwise(mode)
        )
        stack = F.when(opens, F.concat(s["stack"], F.array(saved))).when(closes, F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).when(token == ";", ints).otherwise(s["stack"])
        found = F.when(taken & (name != ""), F.concat(s["found"], F.array(name))).otherwise(s["found"])
        return F.struct(follows.cast("int").alias("mode"), stack.cast("array<int>").alias("stack"), word.alias("before"), found.alias("found"))

    return F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["found"]))
