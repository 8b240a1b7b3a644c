"""SQL token walk, model registry and reaching constants, on statements and sources of our own."""

import ast

import pytest
from pyspark.sql import functions as F

from radiograph.functions.statements import walked_tables
from radiograph.operators import code

STATEMENTS = [
    ("SELECT id, name FROM users WHERE active = true", "users"),
    ("SELECT u.id FROM users u INNER JOIN orders o ON u.id = o.user_id LEFT JOIN addresses a ON u.address_id = a.id", "users orders addresses"),
    ("INSERT INTO audit_logs (actor, action) VALUES ('admin', 'login from nowhere')", "audit_logs"),
    ("UPDATE accounts SET balance = balance + 100, x = 1 WHERE id = 42", "accounts"),
    ("DELETE FROM user_sessions WHERE expires_at < NOW()", "user_sessions"),
    ("SELECT * FROM public.products p JOIN inventory.stocks s ON p.id = s.product_id", "public.products inventory.stocks"),
    ("SELECT * FROM (SELECT id, amount FROM payments) p JOIN accounts a ON p.acct_id = a.id", "payments accounts"),
    ('select * from t1, t2 as x, (select 1 from ((select 2 from t3, s.t4)) q, t5) y, "T6" where id in (select id from `t7`)', "t1 t2 t3 s.t4 t5 t6 t7"),
    ("select extract(year from ts), trim(both ' ' from n) from t1 where x is distinct from y for update", "t1"),
    ("create table if not exists a.b (id int)", "a.b"),
    ("drop table if exists x1; truncate table only x2", "x1 x2"),
    ("insert into t (a) values (1) on conflict do update set a = 2", "t"),
    ("select /* from no */ 1 from yes -- from never\n, also", "yes also"),
    ("FROM the data", ""),
    ("select a from t join (x1 join x2 on x1.i = x2.i), x3 on 1=1", "t x1 x2 x3"),
    ("with r as (select 1 from base) select * from r", "base r"),
    ("", ""),
    (None, ""),
    ("select 1 from 'quoted' q", "quoted"),
    ("from [my table].[x y], z", "mytable.xy z"),
    ("update Users set n=(select max(b) from Other)", "users other"),
    ("select f(a, b), g from t, u, v group by a, b", "t u v"),
    ("select count(*) from t1;select 2 from t1, t2", "t1 t2"),
    ("select ((((((1)))))) from (((((deep))))) x, after", "deep after"),
    ("select 'it''s from here' from t where a = 'x from y'", "t"),
]

SOURCE = '''import x
class OrderItem(Base):
    """doc"""
    __tablename__ = "Order_Lines"  # here
class User(models.Model):
    n = 1
    class Meta:
        db_table = 'auth_user'
    def save(self):
        q = "SELECT 1 FROM a1"
        cursor.execute(q)
        q = f"select {x}"
        cursor.execute(q); q = 3
        db.executemany("""SELECT *
   FROM a2 JOIN s.a3 ON 1""", [1])
        x = db.execute("select " + y)
        self.c.execute(self.sql)
        c.execute("x {}".format(1)); c.execute(build(1)); c.execute()
        c.execute(f"select {x} from no")
        c.execute("nothing here")
async def other(a):
    sql = ("select 1 "
           "from a4")
    s: str = 'select 2 from a5'
    c.execute(sql, [1])
    c.execute(s)
    c.execute(later)
    later = "select 1 from a6"
    session.query(OrderItem, m.User).all(); select(Thing); Person.objects.filter(x=1); Order.objects.get()
    session.execute(select(User))
'''
OTHER = "class Thing:\n  __tablename__='T2'\nclass OrderItem:\n\t__tablename__ = 'lines2'\ndef f():\n  return select(Category)"


def files(spark):
    return spark.createDataFrame([("a.py", SOURCE), ("b.py", None), ("c.py", OTHER), ("d.py", "")], "path string, content string")


def test_walk(spark):
    rows = spark.createDataFrame(STATEMENTS, "q string, w string").select("q", "w", F.array_join(walked_tables(F.col("q")), " ").alias("g")).collect()
    assert [(r["q"], r["g"]) for r in rows if r["g"] != r["w"]] == []


def by_syntax_tree(source, anywhere):
    """The calls of the outer functions' bodies by Python's own parser: (line, kind of argument, constant or None)."""
    out = []
    for fn in [n for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]:
        sets = sorted((n.lineno, n.col_offset, t.id, n.value.value if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) else None) for n in ast.walk(fn) if isinstance(n, (ast.Assign, ast.AnnAssign)) and n.col_offset < 13 for t in (n.targets if isinstance(n, ast.Assign) else [n.target]))
        for call in [n for n in ast.walk(fn) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("execute", "executemany") and n.args]:
            arg = call.args[0]
            value = arg.value if isinstance(arg, ast.Constant) and isinstance(arg.value, str) else None
            if isinstance(arg, ast.Name):
                known = [v for line, _, name, v in sets if name == arg.id and (v is not None if anywhere else line < call.lineno)]
                value = known[-1] if known else None
            out.append((call.lineno, type(arg).__name__, value))
    return sorted(out, key=str)


@pytest.mark.parametrize("anywhere", [False, True])
def test_reaching_constants(spark, anywhere):
    source = SOURCE.replace("; q = 3", "\n        q = 3")  # what shares a line with a call isn't told apart by line
    frame = spark.createDataFrame([("a.py", source)], "path string, content string")
    tables = {r["q"]: r["t"] for r in spark.createDataFrame([(v,) for _, _, v in by_syntax_tree(source, anywhere) if v], "q string").distinct().select("q", walked_tables(F.col("q")).alias("t")).collect()}
    want = {(line, kind, f"table:{t}") for line, kind, v in by_syntax_tree(source, anywhere) if v is not None for t in tables.get(v, [])} | {(line, kind, "table:unresolved") for line, kind, v in by_syntax_tree(source, anywhere) if v is None}
    got = {(r["line"], r["argument"], r["target"]) for r in code.executed_queries(frame, anywhere).collect()}
    assert got == want


def test_registry(spark):
    assert {tuple(r) for r in code.registry(files(spark)).collect()} == {("OrderItem", "lines2"), ("Thing", "t2"), ("User", "auth_user")}
    tables = spark.createDataFrame([("table:public.auth_user", "auth_user", 1), ("table:x.people", "people", 2), ("table:y.people", "people", 3)], "id string, name string, seq long")
    got = {(r["source"].split(":")[2], r["target"], r["model"], r["orm"], r["line"]) for r in code.model_references(files(spark), tables).collect()}
    assert got == {
        ("other", "table:lines2", "OrderItem", "sqlalchemy", 29), ("other", "table:public.auth_user", "User", "sqlalchemy", 29), ("other", "table:t2", "Thing", "sqlalchemy", 29),
        ("other", "table:x.people", "Person", "django", 29), ("other", "table:orders", "Order", "django", 29), ("other", "table:public.auth_user", "User", "sqlalchemy", 30), ("f", "table:categories", "Category", "sqlalchemy", 6),
    }
    assert code.model_references(files(spark).limit(0)).collect() == [] == code.executed_queries(files(spark).where("path = 'b.py'")).collect()
