from pyspark.sql import functions as F

from radiograph.functions import names
from radiograph.operators import changes, clusters, extraction, graph, naming, schemas, statistics

NODES = [(i, n, t, n.split(".")[-1] if t == "table" else n, "here") for i, (n, t) in enumerate([
    ("table:lib.readers", "table"), ("table:lib.loans", "table"), ("table:lib.copies", "table"), ("table:lib.books", "table"), ("table:lib.book_shelves", "table"),
    ("func:desk.py:find_reader", "function"), ("func:desk.py:lend", "function"), ("func:attic.py:search", "function"), ("file:desk.py", "file"), ("file:attic.py", "file"),
])]
EDGES = [
    (0, "table:lib.loans", "table:lib.readers", "declared_fk", 10000), (1, "table:lib.loans", "table:lib.copies", "declared_fk", 10000), (2, "table:lib.copies", "table:lib.books", "declared_fk", 10000),
    (3, "table:lib.books", "table:lib.book_shelves", "inferred_naming", 6100), (4, "func:desk.py:find_reader", "table:lib.readers", "static_sql_string", 8700),
    (5, "func:desk.py:find_reader", "table:lib.loans", "orm_call", 7500), (6, "func:desk.py:lend", "table:lib.loans", "orm_call", 9000), (7, "func:desk.py:lend", "table:lib.copies", "static_sql_string", 9600),
    (8, "func:attic.py:search", "table:unresolved", "dynamic_unresolved", 1500), (9, "func:desk.py:find_reader", "file:desk.py", "structural_belongs_to", 10000),
    (10, "func:desk.py:lend", "file:desk.py", "structural_belongs_to", 10000), (11, "func:attic.py:search", "file:attic.py", "structural_belongs_to", 10000),
]


def tables(spark):
    return spark.createDataFrame(NODES, "seq long, id string, type string, name string, source_system string"), spark.createDataFrame(EDGES, "seq long, source string, target string, type string, c4 long")


def reached(spark, root, depth, least=0):
    _, edges = tables(spark)
    rows = graph.blast_radius(graph.propagation(edges), spark.createDataFrame([(root,)], "root string"), depth, least).collect()
    return {r["node"]: (r["c4"], r["depth"]) for r in rows}


def test_blast_radius(spark):
    one = reached(spark, "table:lib.readers", 1)
    assert one == {"table:lib.loans": (10000, 1), "func:desk.py:find_reader": (8700, 1)}
    assert reached(spark, "table:lib.readers", 2) == one | {"func:desk.py:lend": (9000, 2), "file:desk.py": (8700, 2)}
    assert reached(spark, "table:lib.readers", 3)["file:desk.py"] == (9000, 3)
    assert reached(spark, "table:lib.book_shelves", 3)["func:desk.py:lend"] == (5856, 3)
    assert reached(spark, "table:unresolved", 2) == {"func:attic.py:search": (1500, 1), "file:attic.py": (1500, 2)}
    assert reached(spark, "table:unresolved", 2, 2000) == {} == reached(spark, "nowhere", 2)


def test_resolve_and_blind_spots(spark):
    nodes, edges = tables(spark)
    more = nodes.union(spark.createDataFrame([(20, "table:db.public.users", "table", "u", "here")], nodes.schema))
    asked = ["readers", "lib.loans", "LIB.Copies", "users", "public.users", "FUNC:desk.py:lend", "nothing", "eaders"]
    found = {r["target"]: r["id"] for r in graph.resolve_targets(more, spark.createDataFrame([(x,) for x in asked], "target string")).collect()}
    assert found == dict(zip(asked, ["table:lib.readers", "table:lib.loans", "table:lib.copies", "table:db.public.users", "table:db.public.users", "func:desk.py:lend", None, None], strict=True))
    spots = {r["kind"]: r for r in graph.blind_spots(nodes, edges).collect()}
    assert spots["dynamic_unresolved_sql"]["n"] == 1 and spots["dynamic_unresolved_sql"]["severity"] == "medium" and spots["unreferenced_tables"]["n"] == 5


def test_assembly(spark):
    nodes, edges = tables(spark)
    is_code = F.col("id").startswith("f")
    calls = [(50, "func:desk.py:lend", "table:Readers", "orm_call", 9800), (51, "func:desk.py:lend", "table:fines", "orm_call", 9800), (52, "func:attic.py:search", "table:unresolved", "dynamic_unresolved", 1500)]
    held, links = graph.assembled_graph(nodes.where(~is_code), edges.where("seq < 4"), nodes.where(is_code), spark.createDataFrame(calls, edges.schema))
    systems = {r["id"]: (r["name"], r["source_system"]) for r in held.collect()}
    assert len(systems) == held.count() == 12 and systems["table:fines"] == ("fines", "code_inferred") and systems["table:unresolved"][1] == "unresolved"
    assert {(r["target"], r["target_type"], r["target_name"]) for r in graph.endpoints(links.where("seq >= 50"), held.where("id <> 'table:fines'")).collect()} == {
        ("table:lib.readers", "table", "readers"), ("table:fines", "unknown", "table:fines"), ("table:unresolved", "table", "<unresolved_dynamic_query>")}


def test_changes(spark):
    nodes, edges = tables(spark)
    held = nodes.withColumn("file", F.when(F.col("name") == "books", "schema/books.prisma"))
    change = lambda *paths: {r["name"] for r in changes.affected_tables(spark.createDataFrame([(p,) for p in paths], "path string"), held, edges, spark.createDataFrame([("db/x.sql", "drop table Book_Shelves;")], "path string, content string")).collect()}
    assert change("src/desk.py") == {"readers", "loans", "copies"} and change("attic.py") == set()
    assert change("db/001_add_copies.sql") == {"copies"} and change("db/x.sql") == {"book_shelves"} and change("x/schema/books.prisma") == {"books"} and change("db/mycopies.sql") == set()
    tables_of, total = changes.change_impact(spark.createDataFrame([("db/001_add_copies.sql",), ("no.py",)], "path string"), held, edges, max_depth=1, high=2)
    assert [tuple(r) for r in tables_of.select("name", "root", "total", "high_risk").collect()] == [("copies", "table:lib.copies", 2, True)]
    assert tuple(total.first()) == (2, 1, 2, 2, 1)
    texts = spark.createDataFrame([(1, "see order_items, please"), (2, "order items"), (3, "reorder_items"), (4, "ORDER_ITEMS2 (order_items)"), (5, None), (6, "a.b"), (7, "quick, brown"), (8, "the quick\nbrown"), (9, "a quick brown fox")], "id long, text string")
    names_of = spark.createDataFrame([("order_items",), ("order",), ("A.B",), ("__",), (None,), ("quick brown",), ("_order",)], "name string")
    assert {tuple(r) for r in changes.mentions(texts, names_of).collect()} == {(1, "order_items"), (1, "order"), (2, "order"), (4, "order_items"), (4, "order"), (6, "a.b"), (9, "quick brown")}


def test_extraction(spark):
    py = "import x\nclass A:\n    async def one(self):\n        Category.objects.filter(a=1)\n        session.query(Box)\n        db.execute('''select a from lib.Readers r join loans l''')\n    def two(): cursor.execute(q)\n"
    js = "// function no() {\nconst load = async (a) => {\n  knex('Loans'); prisma.person.findMany(); JSON.update(1)\n  if (x) {\n    Person.findAll(); client.query(`select 1 from loans`)\n    client.query(sql); client.query(sql)\n  }\n}\nfunction last() { return db.raw(\"delete from copies\") }"
    got = lambda text, language: sorted((r["source"].split(":")[2], r["target"], r["type"][:3]) for r in extraction.references(spark.createDataFrame([("a", text)], "path string, content string"), language).where("type <> 'structural_belongs_to'").collect())
    assert got(py, "python") == [("one", "table:boxes", "orm"), ("one", "table:categories", "orm"), ("one", "table:loans", "sta"), ("one", "table:readers", "sta"), ("two", "table:unresolved", "dyn")]
    assert got(js, "javascript") == [("last", "table:copies", "sta"), ("load", "table:loans", "orm"), ("load", "table:people", "orm"), ("load", "table:unresolved", "dyn"), ("load", "table:unresolved", "dyn")]
    assert got("x = 1", "python") == [] and got(None, "go") == []
    assert got("interface R extends CrudRepository<Copy, Long> {}", "java") == [("R", "table:copies", "orm")]
    assert got('  @Query("select c from copies c")\n  List<Copy> all(int a) {', "java") == [("all", "table:copies", "sta")] * 0
    bounds = extraction.functions(spark.createDataFrame([("a", js), ("b", "")], "path string, content string"), extraction.LANGUAGES["javascript"]).collect()
    assert [(r["path"], r["name"], r["start"], r["end"]) for r in bounds] == [("a", "load", 2, 8), ("a", "last", 9, 9), ("b", "<module>", 1, 1)]
    literal = extraction.literal_references(spark.createDataFrame([("a.rs", "run(\"SELECT a FROM b\"); no('x'); run(`update c set d`)")], "path string, content string"))
    assert {(r["source"], r["target"]) for r in literal.where("type = 'static_sql_string'").collect()} == {("func:a.rs:query_1", "table:b"), ("func:a.rs:query_2", "table:c")}


def test_schemas(spark):
    text = "-- create table no (a int);\nCREATE TABLE IF NOT EXISTS public.\"Loans\" (\n id serial, reader INT NOT NULL references readers, copy int, price numeric(8,2) default 0,\n PRIMARY KEY (id), CONSTRAINT c FOREIGN KEY (copy, id) REFERENCES shop.copies (a, b), CHECK (price in (1, 2)));\nalter table only loans add constraint f foreign key (copy) references copies;"
    columns, keys = schemas.ddl(spark.createDataFrame([("a", text), ("b", None)], "path string, content string"), True)
    assert {(r["column"], r["type"], r["primary_key"], r["nullable"]) for r in columns.collect()} == {("id", "serial", True, False), ("reader", "int", False, False), ("copy", "int", False, True), ("price", "numeric(8,2)", False, True)}
    assert {(r["table"], r["column"], r["target"], r["target_column"]) for r in keys.collect()} == {("loans", "reader", "readers", "id"), ("loans", "copy", "shop.copies", "a"), ("loans", "id", "shop.copies", "b"), ("loans", "copy", "copies", "id")}


def test_communities(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1) for c in "abc" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1), ("b1", "c1", 1)]
    pairs = spark.createDataFrame(cliques, "a string, b string, w long")
    labels = clusters.communities(pairs)
    of = {r["node"]: r["community"] for r in labels.collect()}
    assert len({(k[0], v) for k, v in of.items()}) == 3 == len(set(of.values()))
    assert clusters.modularity(pairs, labels).first()["q"] > 0.55
    members = spark.createDataFrame([(1, "order_items", "h"), (1, "order_lines", "h"), (1, "price_lines", "h"), (2, "users", "users"), (3, "a_b", "ab"), (3, "c", "ab")], "community long, name string, hub string")
    assert {r["community"]: r["label"] for r in clusters.cluster_labels(members).collect()} == {1: "Order & Lines Domain", 2: "Users Module", 3: "Ab Domain"}
    nodes, edges = tables(spark)
    found, isolated, q = clusters.cluster_catalog(nodes.union(spark.createDataFrame([(30, "table:lib.lonely", "table", "lonely", "x")], nodes.schema)), edges)
    assert isolated.collect()[0]["name"] == "lonely" and sum(r["size"] for r in found.collect()) == 5 and q.first()["q"] is not None


def test_names(spark):
    pairs = {"user": "users", "person": "people", "category": "categories", "address": "addresses", "batch": "batches", "box": "boxes", "wolf": "wolves", "knife": "knives", "analysis": "analyses"}
    rows = spark.createDataFrame(list(pairs.items()), "s string, p string").select("s", "p", names.pluralize(F.col("s")).alias("a"), names.singularize(F.col("p")).alias("b")).collect()
    assert all(r["a"] == r["p"] for r in rows)
    assert all(r["b"] == r["s"] for r in rows if r["s"] != "knife")
    c = spark.createDataFrame([("usr",), ("shipping_address",), ("billing_addr",)], "s string").select("s", F.explode(names.candidate_tables(F.col("s"))).alias("c")).collect()
    got = {(r["s"], r["c"]["name"]): r["c"]["m10"] for r in c}
    assert got["usr", "usr"] == 10 and got["usr", "users"] == 9 and got["shipping_address", "addresses"] == 9 and got["billing_addr", "address"] == 9 and got["shipping_address", "shipping_addresses"] == 10
    sql = [("SELECT id FROM users WHERE a", ["users"]), ("x FROM public.products p JOIN inventory.stocks s", ["products", "stocks"]), ("UPDATE `acc` SET", ["acc"]), ("FROM (SELECT 1 FROM t) JOIN select", ["t"])]
    assert all(r["t"] == r["w"] for r in spark.createDataFrame(sql, "q string, w array<string>").select("w", names.sql_tables(F.col("q")).alias("t")).collect())


def test_naming_inference(spark):
    t = spark.createDataFrame([("public.users", "public", "users", 0), ("public.orders", "public", "orders", 1), ("public.categories", "public", "categories", 2), ("tenant.users", "tenant", "users", 3)], "full_name string, schema string, name string, seq long")
    c = spark.createDataFrame([("public.orders", "user_id"), ("public.orders", "usr_id"), ("public.users", "user_id"), ("public.categories", "parent_category_id"), ("public.orders", "note")], "full_name string, column string")
    got = {(r["source"], r["target"]): (r["c4"], r["match_type"]) for r in naming.infer(t, c).collect()}
    assert got == {("public.orders", "public.users"): (9200, "exact"), ("public.categories", "public.categories"): (8280, "fuzzy")}
    one = spark.createDataFrame([("a", "b", "x", 1), ("b", "c", "x", 1)], "source string, target string, type string, c4 long")
    two = spark.createDataFrame([("a", "b", "y", 1), ("c", "d", "y", 1)], "source string, target string, type string, c4 long")
    assert tuple(naming.merge_stats(one, two).first()) == (1, 1, 1, 5000)
    assert naming.merge(one, two).count() == 4 and naming.merge(one, two, True).count() == 3


def test_statistics(spark):
    rows = spark.createDataFrame([(0.85, int(i < 8)) for i in range(10)] + [(0.95, 1)] * 10, "p double, actual long")
    curve = {r["bucket"]: r for r in statistics.calibration_curve(rows).collect()}
    assert curve[8]["error"] == 0.05 and curve[9]["within"] and curve[0]["n"] == 0 and len(curve) == 10
    assert statistics.brier(rows.limit(0)).first()[0] == 0.0
    lower, upper = statistics.wilson(F.lit(50), F.lit(50))
    assert tuple(spark.range(1).select(lower, upper).first()) == (0.9286, 1.0)


def test_suffix_paths(spark):
    a = spark.createDataFrame([("./src/app/auth.py",), ("other.py",), ("",)], "path string")
    b = spark.createDataFrame([("app\\auth.py",), ("x/other.py",), ("thother.py",), (None,)], "path string")
    assert {tuple(r) for r in changes.suffix_matches(a, b).collect()} == {("src/app/auth.py", "app/auth.py"), ("other.py", "x/other.py")}
