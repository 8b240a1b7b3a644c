"""Source files that Spark derives from the order tables, so that extraction has texts that grow with them.

A file for each customer, a function for each of its orders, and a line for each lineitem: a query held as a literal, an
ORM call or a call with a variable, by its return flag. What extraction has to find is therefore known from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

#: language -> (extension, function header, line of an ORM call, of a literal, of a call with a variable, first line of a file);
#: {o} is the order, {m} the model, {b} the table, {s} the customer's segment, {c} the customer.
STYLES = {
    "python": ("py", "def order_{o}(self):", "    {m}.objects.filter(id=1)", '    cursor.execute("SELECT id FROM {b} WHERE id = 1")', "    cursor.execute(statement)", "# {s}"),
    "javascript": ("js", "async function order_{o}(id) {", "  await {m}.findAll()", '  client.query("SELECT id FROM {b} WHERE id = 1")', "  client.query(statement)", "// {s}"),
    "go": ("go", "func order_{o}(c Ctx) error {", "  db.Find(&{m})", '  db.Raw("SELECT id FROM {b} WHERE id = 1")', "  run(statement)", "// {s}"),
    "java": ("java", "  public List<Row> order_{o}(long id) {", "    load({m}.class);", '    em.createNativeQuery("SELECT id FROM {b} WHERE id = 1");', "    run(statement);", "interface Orders{c} extends JpaRepository<{s}, Long> {{}}"),
    "ruby": ("rb", "  def order_{o}", "    {m}.where(id: 1)", '    execute("SELECT id FROM {b} WHERE id = 1")', "    run statement", "# {s}"),
    "php": ("php", "  public function order_{o}($id) {", "    {m}::where('id', 1);", '    run("SELECT id FROM {b} WHERE id = 1");', "    run($statement);", "// {s}"),
    "rust": ("rs", "fn order_{o}() {", "  load::<{m}>();", '  run("SELECT id FROM {b} WHERE id = 1");', "  run(statement);", "// {s}"),
}


def code_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """files(path, content) in a language."""
    extension, header, orm, literal, dynamic, first = STYLES[language]

    def filled(style: str, **values: str):
        text = F.lit(style.replace("{{}}", "{}"))
        for key, column in values.items():
            text = F.replace(text, F.lit("{" + key + "}"), F.col(column).cast("string"))
        return text

    part = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("b"), F.initcap(F.split("p_name", " ")[1]).alias("m"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    shown = F.when(F.col("l_returnflag") == "A", filled(orm, m="m")).when(F.col("l_returnflag") == "R", filled(literal, b="b")).otherwise(F.lit(dynamic))
    lines = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", shown.alias("line")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.concat_ws("\n", filled(header, o="o_orderkey"), F.transform("lines", lambda x: x["line"]))
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("body")))).alias("orders"))
    files = files.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    content = F.concat_ws("\n", filled(first, s="c_mktsegment", c="c_custkey"), F.transform("orders", lambda x: x["body"]))
    return files.select(F.concat(F.lit("src/c"), F.col("c_custkey").cast("string"), F.lit(f".{extension}")).alias("path"), content.alias("content"))


#: kind -> (extension, an order's table, a line for the order before it, what comes after, and the end of a file's first order).
SCHEMAS = {
    "ddl": ("sql", "CREATE TABLE shop.orders_{o} (\n  id INTEGER PRIMARY KEY, -- key, of course\n  total NUMERIC(10, 2) NOT NULL,\n  note VARCHAR(20)", ",\n  prev_id INTEGER REFERENCES shop.orders_{p}(id)", ",\n  cust_id INTEGER,\n  FOREIGN KEY (cust_id) REFERENCES customers (id),\n  CHECK (total > 0)\n);"),
    "full": (
        "sql", "CREATE TABLE shop.orders_{o} (\n  id INTEGER PRIMARY KEY, -- a key; (of course\n  deep NUMERIC(10, 2) DEFAULT ((((1 + (2 * 3))))) CHECK (deep IN (1, (2), ((3)))),\n  note VARCHAR(20) DEFAULT 'a, (b; c',\n  cust_id INTEGER NOT NULL",
        ",\n  prev_id INTEGER REFERENCES shop.orders_{p}(id)",
        ",\n  CONSTRAINT pair_{o} FOREIGN KEY (id, cust_id) REFERENCES shop.pairs (a, b) ON DELETE CASCADE,\n  FOREIGN KEY (cust_id) REFERENCES customers\n) PARTITION BY RANGE (id);\n"
        "CREATE TABLE orders_{o}_y PARTITION OF shop.orders_{o} FOR VALUES FROM (1) TO (2);\nCREATE OR REPLACE VIEW shop.v_{o} (a, b) AS SELECT id, f(note, 1) FROM shop.orders_{o};\n"
        "ALTER TABLE ONLY shop.orders_{o} ADD CONSTRAINT self_{o} FOREIGN KEY (deep) REFERENCES shop.orders_{o} (id);",
    ),
    "prisma": ("prisma", "model Order{o} {\n  id Int @id\n  total Float?", "\n  prev Order{p} @relation(fields: [prev_id], references: [id])\n  prev_id Int", "\n  // a note\n  @@index([total])\n}"),
    "rails": ("rb", 'create_table "orders_{o}" do |t|\n  t.float "total"', '\n  t.integer "order_{p}_id", null: false', '\nend\nadd_foreign_key "orders_{o}", "customers"'),
}


def schema_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """files(path, content): a schema for each customer with a table for each order, which refers to the order before it."""
    extension, begin, before, end = SCHEMAS[kind]
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("o"), "o_orderkey")
    orders = orders.withColumn("p", F.lag("o").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    text = F.concat(F.replace(F.lit(begin), F.lit("{o}"), F.col("o")), F.coalesce(F.replace(F.lit(before), F.lit("{p}"), F.col("p")), F.lit("")), F.replace(F.lit(end), F.lit("{o}"), F.col("o")))
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", text.alias("text")))).alias("x"))
    return files.select(F.concat(F.lit("schema/c"), F.col("o_custkey").cast("string"), F.lit(f".{extension}")).alias("path"), F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("content"))


#: How a line's tables stand in an order's statement, by line number modulo five; {b} is the table.
FROM_ITEMS = ("{b} AS t", "shop.{b} t", "(SELECT id FROM \"{b}\" WHERE x = 'from {b}x, y') t", "((SELECT max(a, b) FROM other.{b} t, `{b}` u)) t", "{b}_x CROSS JOIN {b}_y")


def _chosen(number: str, styles: tuple[str, ...], **values: str) -> Column:
    """The style of a line's number, filled in."""
    texts = []
    for style in styles:
        text = F.lit(style)
        for key, column in values.items():
            text = F.replace(text, F.lit("{" + key + "}"), F.col(column).cast("string"))
        texts.append(text)
    return F.element_at(F.array(*texts), (F.pmod(F.col(number), F.lit(len(styles))) + 1).cast("int"))


def _ordered(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    """(o_orderkey, o_custkey, lines) with an order's lines, by number and text."""
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select("p_partkey", brand.alias("b"), F.lower(words[1]).alias("w"), F.concat(F.initcap(words[1]), F.initcap(words[0])).alias("m"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    held = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _files(orders: DataFrame, path: str, first: str, header: str) -> DataFrame:
    """files(path, content): a file for each customer, a function for each of its orders."""
    named = lambda text, key, column: F.replace(F.lit(text), F.lit(key), F.col(column).cast("string"))
    body = F.concat_ws("\n", named(header, "{o}", "o_orderkey"), F.coalesce("lines", F.array().cast("array<string>")))
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("body")))).alias("x"))
    return files.select(named(path, "{c}", "o_custkey").alias("path"), F.concat_ws("\n", F.lit(first), F.transform("x", lambda x: x["body"])).alias("content"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, statement): SQL for each order, over the tables of its lines, nested and listed in several ways."""
    held = _ordered(spark, sf_dir, _chosen("l_linenumber", FROM_ITEMS, b="b"))
    segment = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s"))
    held = held.join(segment, F.col("o_custkey") == F.col("c_custkey"))
    items = F.aggregate(F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, " LEFT JOIN ").otherwise(", "), x)), F.lit(""), lambda a, x: F.concat(a, x))
    text = F.concat(F.lit("WITH r AS (SELECT 1) -- from nothing, not even this\nSELECT extract(year FROM d), 'from here' FROM "), items, F.lit(" WHERE k IN (SELECT id FROM "), F.col("s"), F.lit(") GROUP BY p, q;\nUPDATE "), F.col("s"), F.lit("_log SET n = 1, m = 2 WHERE d IS DISTINCT FROM e"))
    return held.select("o_orderkey", text.alias("statement"))


#: What a line of an order does in a function, by line number modulo six.
CALLS = (
    '    query = "SELECT id FROM {b}"', "    cursor.execute(query)", '    query = build("{b}")', '    cursor.execute(f"SELECT {b} FROM nowhere")',
    '    db.executemany("""SELECT id\n      FROM shop.{b}, {w}""", rows)', '    cursor.execute("SELECT 1 FROM " + query)',
)


def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content) in Python whose functions assign constants and other values to a variable, and execute it and others."""
    return _files(_ordered(spark, sf_dir, _chosen("l_linenumber", CALLS, b="b", w="w")), "src/q{c}.py", "import db", "def order_{o}(cursor):")


#: How a part's file declares its model, by part number modulo three, and how a line uses one, by line number modulo three.
MODELS = ('class {m}(Base):\n    id = 1\n    __tablename__ = "{t}"\n', "class {m}(models.Model):\n    n = 1\n    class Meta:\n        db_table = '{t}'\n    def save(self):\n        pass", "class {m}Line:\n    pass")
USES = ("    session.query({m}).all()", "    return select(m.{m})", "    {m}.objects.filter(id=1)")


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content) in Python: one for each part, which may declare a model, and one for each customer, which uses them."""
    words = F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.initcap(words[1]), F.initcap(words[0])).alias("m"), F.concat(F.initcap(words[0]), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("t"))
    declared = part.select(F.concat(F.lit("models/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), _chosen("p_partkey", MODELS, m="m", t="t").alias("content"))
    return declared.unionByName(_files(_ordered(spark, sf_dir, _chosen("l_linenumber", USES, m="m")), "src/m{c}.py", "import m", "def order_{o}(session):"))


def model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, seq): a qualified table for every other part's table of a model."""
    name = F.lower(F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit("_"), F.replace("p_brand", F.lit("#"), F.lit(""))))
    return table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("table:"), F.lower(F.split("p_type", " ")[0]), F.lit("."), name).alias("id"), name.alias("name"), F.col("p_partkey").alias("seq"))


#: language -> (extension, first line, function headers by order number, lines by part and line number with what extraction
#: has to find in them): `b`, `b_y` are tables, `m` the model's, `?` a call that can't be resolved; nothing for what only
#: looks like a reference. (The patterns don't pair quotes: a comment with a whole statement right after a literal would count.)
FORMS = {
    "python": ("py", "import db", ("def order_{o}(self):", "async def order_{o}(self, a):", "    def order_{o}(a): pass"), (
        ("    {m}.objects.filter(id=1)", "m"), ("    x = {m}.objects.bulk_create(rows)", "m"), ("    {m}.objects.first()", ""), ("    session.query({m}).all()", "m"), ("    y = select({m}, other)", "m"),
        ('    run("""SELECT id\n      FROM shop.{b} JOIN {b}_y ON 1""")', "b b_y"), ('    run("insert into {b} (a) values (1)")', "b"), ("    run('UPDATE {b}\n      SET a = 1')", "b"), ("    run('DELETE FROM {b}')", "b"),
        ("    # nothing from {b} here", ""), ("    cursor.execute(statement, [1])", "?"), ("    db.raw(statement)", "?"), ("    cursor.execute(f(statement))", ""), ("    {w}.objects.all()", ""),
    )),
    "javascript": ("js", "// nothing", ("async function order_{o}(id) {", "export const order_{o} = async (id, x) => {", "  async order_{o}(id) {"), (
        ("  await knex('{b}').where(1)", "b"), ("  return prisma.{w}.findMany({ take: 1 })", "p"), ("  {m}.findAll()", "p"), ("  Promise.create(x)", ""), ("  {m}.list()", ""),
        ('  client.query("SELECT id FROM shop.{b}")', "b"), ("  db.raw('delete from {b}')", "b"), ("  const q = `SELECT id\n    FROM {b}\n    JOIN {b}_y ON 1`", "b b_y"), ("  say('nothing from {b}')", ""), ("  client.query(statement, [1])", "?"), ("  db.execute(statement)", "?"), ("  client.query(build(statement))", ""),
    )),
    "go": ("go", "package main", ("func order_{o}(c Ctx) error {", "func (s *Store) order_{o}(c Ctx) {"), (
        ('  db.Table("{b}").Find(x)', "b"), ("  db.First(&{m}{})", "m"), ("  tx.Create(&models.{m}{})", "m"), ("  db.Count(&{m}{})", ""), ("  rows := run(`SELECT id\n    FROM {b}\n    WHERE a = 1`)", "b"), ('  run("UPDATE {b} SET a = 1")', "b"), ("  // nothing from {b}", ""), ("  run(statement)", ""),
    )),
    "java": ("java", "class Orders {", ("  public List<Row> order_{o}(long id) {", "  private static final Row[] order_{o}(long id) throws Oops {"), (
        ('    @Query("SELECT x FROM {b} x")', "b b"), ('    @Query(value = "from {b}_y y")', "b_y"), ('    em.createNativeQuery("DELETE FROM shop.{b} WHERE id = 1");', "b"), ('    run("insert into {b} values (1)");', "b"), ("    load({m}.class);", ""), ("    run(statement);", ""), ('    say("nothing from {b}");', ""),
    )),
    "ruby": ("rb", "class Orders", ("  def order_{o}", "  def order_{o}?(x)"), (
        ("    {m}.where(id: 1)", "m"), ("    {m}.find_by id: 1", "m"), ("    {m}.create!(a)", "m"), ("    {m}.first", ""), ("    File.create(x)", ""), ('    run("SELECT id FROM {b}\n      WHERE a = 1")', "b"), ("    run('UPDATE {b} SET a = 1')", "b"), ("    # nothing from {b}", ""), ("    run statement", ""),
    )),
    "php": ("php", "<?php", ("  public function order_{o}($id) {", "  private static function order_{o}() {", "function order_{o}($a, $b) {"), (
        ("    DB::table('{b}')->get();", "b"), ("    {m}::where('id', 1);", "m"), ("    {m}::findOrFail(1);", "m"), ("    {m}::count();", ""), ("    Route::all(1);", ""), ('    run("SELECT id FROM shop.{b}");', "b"), ("    run('insert into {b} (a) values (1)');", "b"), ("    run($statement);", ""), ("    say('nothing from {b}');", ""),
    )),
}


def form_files(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """files(path, content) in a language, whose functions hold every kind of line that its patterns find or have to leave."""
    extension, first, headers, forms = FORMS[language]
    brand, words = F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.split("p_name", " ")
    part = table(spark, sf_dir, "part").select("p_partkey", brand.alias("b"), F.lower(words[1]).alias("w"), F.initcap(words[1]).alias("m"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_partkey") + F.col("l_linenumber")).alias("n"), "l_linenumber").join(part, F.col("l_partkey") == F.col("p_partkey"))
    shown = _chosen("n", tuple(text for text, _ in forms), b="b", w="w", m="m")
    held = lines.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", shown.alias("line")))), lambda x: x["line"]).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    body = F.concat_ws("\n", _chosen("o_orderkey", headers, o="o_orderkey"), F.coalesce("lines", F.array().cast("array<string>")))
    files = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("body")))).alias("x"))
    return files.select(F.concat(F.lit("src/f"), F.col("o_custkey").cast("string"), F.lit(f".{extension}")).alias("path"), F.concat_ws("\n", F.lit(first), F.transform("x", lambda x: x["body"])).alias("content"))
