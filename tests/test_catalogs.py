"""Declared keys, hierarchies and schema texts of a server, on rows of our own."""

from radiograph.operators import catalogs, schemas


def test_declared_keys(spark):
    constraints = spark.createDataFrame([("fk", "shop", "lines", "FOREIGN KEY"), ("fk", "other", "lines", "FOREIGN KEY"), ("pk", "shop", "orders", "PRIMARY KEY"), ("fk", "pg_catalog", "x", "FOREIGN KEY"), ("one", "shop", "a", "FOREIGN KEY")], "constraint_name string, table_schema string, table_name string, constraint_type string")
    referential = spark.createDataFrame([("fk", "shop", "pk", "shop", "CASCADE", "NO ACTION"), ("fk", "other", "pk", "shop", None, None), ("one", "shop", "uq", "shop", "NO ACTION", "SET NULL"), ("fk", "pg_catalog", "pk", "shop", None, None)], "constraint_name string, constraint_schema string, unique_constraint_name string, unique_constraint_schema string, update_rule string, delete_rule string")
    usage = [
        ("fk", "shop", "shop", "lines", "o_no", 1, 2), ("fk", "shop", "shop", "lines", "o_year", 2, 1), ("fk", "other", "other", "lines", "n", 1, 2), ("fk", "other", "other", "lines", "y", 2, 1),
        ("pk", "shop", "shop", "orders", "year", 1, None), ("pk", "shop", "shop", "orders", "no", 2, None), ("one", "shop", "shop", "a", "b_id", 1, 1), ("uq", "shop", "shop", "b", "id", 1, None), ("fk", "pg_catalog", "pg_catalog", "x", "n", 1, 1),
    ]
    columns = spark.createDataFrame(usage, "constraint_name string, constraint_schema string, table_schema string, table_name string, column_name string, ordinal_position int, position_in_unique_constraint int")
    got = {r["evidence"]: (r["source"], r["target"], r["source_columns"], r["target_columns"], r["update_rule"]) for r in catalogs.declared_keys(constraints, referential, columns).collect()}
    assert got == {
        "FK fk: shop.lines(o_no, o_year) -> shop.orders(no, year)": ("table:shop.lines", "table:shop.orders", ["o_no", "o_year"], ["no", "year"], "CASCADE"),
        "FK fk: other.lines(n, y) -> shop.orders(no, year)": ("table:other.lines", "table:shop.orders", ["n", "y"], ["no", "year"], None),
        "FK one: shop.a(b_id) -> shop.b(id)": ("table:shop.a", "table:shop.b", ["b_id"], ["id"], "NO ACTION"),
    }
    assert {r["source"] for r in catalogs.declared_keys(constraints, referential, columns, ("other",)).collect()} == {"table:other.lines"}


def test_hierarchy(spark):
    classes = [(1, "logs", "p", None), (2, "logs_y", "p", True), (3, "logs_y_m", "r", True), (4, "base", "r", None), (5, "child", "r", None), (6, "grandchild", "r", False), (7, "both", "r", None), (8, "seen", "v", None), (9, "empty", "p", None)]
    classes = spark.createDataFrame([(*c, 1) for c in classes], "oid long, relname string, relkind string, relispartition boolean, relnamespace long")
    spaces = spark.createDataFrame([(1, "public")], "oid long, nspname string")
    inherits = spark.createDataFrame([(2, 1), (3, 2), (5, 4), (6, 5), (7, 4), (7, 2)], "inhrelid long, inhparent long")
    links = catalogs.inheritance(inherits, classes, spaces)
    tables = spark.createDataFrame([("public", n, "VIEW" if n == "seen" else "BASE TABLE") for n in ("logs", "logs_y", "logs_y_m", "base", "child", "grandchild", "both", "seen", "empty")], "table_schema string, table_name string, table_type string")
    columns = spark.createDataFrame([("public", "base", "b", 2, "int", "NO"), ("public", "base", "a", 1, "text", "YES"), ("public", "gone", "x", 1, "int", "NO")], "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")
    catalog = catalogs.raw_catalog(tables, columns)
    assert {r["full_name"]: [(c["name"], c["is_nullable"]) for c in r["columns"]] for r in catalog.collect() if r["columns"]} == {"public.base": [("a", True), ("b", False)]}
    nodes = {r["name"]: (r["type"], r["parent"], r["root"], r["levels"], r["is_partitioned"]) for r in catalogs.server_nodes(catalog, links, catalogs.partitioned(classes, spaces)).collect()}
    assert nodes["logs_y_m"] == ("partition", "public.logs_y", "public.logs", 2, False) and nodes["logs"] == ("table", None, None, 0, True) and nodes["empty"][4]
    assert nodes["grandchild"] == ("table", "public.child", "public.base", 2, False) and nodes["seen"][0] == "view" and nodes["both"][0] == "partition"
    edges = {(r["source"], r["evidence"], r["relationship"]) for r in catalogs.structural_edges(links).collect()}
    assert ("table:public.logs_y", "Partition of public.logs", "partition") in edges and ("table:public.child", "Inherits from public.base", "inheritance") in edges and len(edges) == 6
    circle = spark.createDataFrame([("a", "b", False), ("b", "c", True), ("c", "a", False)], "child string, parent string, is_partition boolean")
    assert {(r["child"], r["ancestor"]) for r in catalogs.ancestry(circle).collect()} == {(x, y) for x in "abc" for y in "abc" if x != y}
    long = spark.createDataFrame([(f"t{i}", f"t{i + 1}", i == 30) for i in range(40)], "child string, parent string, is_partition boolean")
    closure = {(r["child"], r["ancestor"]): (r["distance"], r["is_partition"]) for r in catalogs.ancestry(long).collect()}
    assert len(closure) == 40 * 41 // 2 and closure["t0", "t40"] == (40, True) and closure["t0", "t30"] == (30, False)


DDL = """/* create table never (a int); */
CREATE TABLE a.b (id int primary key, x numeric(8,2) default ((((((1)))))), "Note" text default 'it''s; (, really' not null, y int references c.d,
  CONSTRAINT "Pair" FOREIGN KEY (id, x) REFERENCES e (f, g), FOREIGN KEY (y) REFERENCES h (i), check ((((y > (1))))), primary key (id));
create function f() returns int as $body$ create table no2 (a int); $body$ language sql;
create table b_2024 partition of a.b for values from (1) to (2);
create or replace view a.v as select 1 from (select 2) x; create materialized view mv (q) as select 1;
alter table only a.b add constraint later foreign key (x) references e (f);
create table last (z int[] )"""


def test_ddl(spark):
    files = spark.createDataFrame([("a", DDL), ("b", None), ("c", ";;(")], "path string, content string")
    objects = {r["name"]: (r["kind"], r["parent"]) for r in schemas.ddl_objects(files).collect()}
    assert objects == {"b": ("table", None), "b_2024": ("partition", "b"), "v": ("view", None), "mv": ("view", None), "last": ("table", None)}
    columns = {(r["table"], r["column"]): (r["type"], r["primary_key"], r["nullable"]) for r in schemas.ddl(files)[0].collect()}
    assert columns == {("b", "id"): ("int", True, False), ("b", "x"): ("numeric(8,2)", False, True), ("b", "note"): ("text", False, False), ("b", "y"): ("int", False, True), ("last", "z"): ("int[]", False, True)}
    keys = {(r["constraint"], tuple(r["columns"]), r["target"], tuple(r["target_columns"])) for r in schemas.ddl_constraints(files).collect()}
    assert keys == {("pair", ("id", "x"), "e", ("f", "g")), ("fk_b_h", ("y",), "h", ("i",)), ("fk_b_y", ("y",), "d", ("id",)), ("later", ("x",), "e", ("f",))}


def test_long_schema_is_read_once(spark):
    """A statement that doesn't end before thousands of others is read in a time that grows with its length, as are nested ones beyond the patterns."""
    import time

    one = "CREATE TABLE t{i} (id int primary key, a numeric(8,2) default ((1)), note text default 'x; (', b int references t0 (id));\n"
    text = "".join(one.replace("{i}", str(i)) for i in range(20000))
    files = spark.createDataFrame([("a", text)], "path string, content string")
    began = time.time()
    assert schemas.ddl_objects(files).count() == 20000 and schemas.ddl(files)[0].count() == 80000 and schemas.ddl_constraints(files).count() == 20000
    assert time.time() - began < 60


def test_deep_and_unclosed(spark):
    deep = "(" * 40 + "1, 2" + ")" * 40
    text = f"create table a (x int default {deep}, y text check ({deep}), primary key (y)); create table b (id int, z text"
    files = spark.createDataFrame([("a", text)], "path string, content string")
    assert {(r["table"], r["column"], r["primary_key"]) for r in schemas.ddl(files)[0].collect()} == {("a", "x", False), ("a", "y", True), ("b", "id", False), ("b", "z", False)}
