"""Maintained graphs, samples of paths, numbering, pairing and reports, on rows of our own."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from radiograph.functions import names
from radiograph.operators import graph, paths, reports
from radiograph.plans.numbering import numbered, zipped
from radiograph.streaming import maintained

FILES = "path string, content string, changed timestamp"


def test_maintained(spark, tmp_path):
    held = {}

    def run(rows):
        spark.createDataFrame([(p, c, datetime(2024, 1, 1, 0, m)) for p, c, m in rows], FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for p, c, m in rows:
            if p is not None and m >= held.get(p, (-1,))[0]:
                held[p] = (m, c)
        maintained.maintain(spark.readStream.schema(FILES).parquet(f"{tmp_path}/in"), names.sql_tables, f"{tmp_path}/out").awaitTermination()
        got = {(r["source"], r["target"], r["n"]) for r in maintained.graph_edges(spark, f"{tmp_path}/out").collect()}
        texts = spark.createDataFrame([(p, c) for p, (_, c) in held.items() if c is not None] or [("none", "")], "p string, c string")
        want = {(f"file:{r['p']}", t, 1) for r in texts.select("p", names.sql_tables(F.col("c")).alias("t")).collect() for t in r["t"]}
        assert got == want

    run([("a", "select 1 from users join orders", 1), ("b", "select 1 from items", 1), ("c", "nothing", 1), (None, "from x", 1), ("d", None, 1)])
    run([("a", "from old", 3), ("a", "from users join people", 5), ("b", None, 4), ("c", "from things", 2)])
    run([("a", "from late", 2), ("b", "from back", 6), ("d", "from d1", 1), ("c", "from things", 7)])  # late, back again, the same again
    assert {(r["target"], r["n_files"]) for r in maintained.graph_metrics(spark, f"{tmp_path}/out").collect()} == {("users", 1), ("people", 1), ("back", 1), ("things", 1), ("d1", 1)}
    deltas = spark.read.parquet(f"{tmp_path}/out/deltas")
    assert deltas.where("batch = 2").count() == 2  # back and d1: what didn't change emits nothing


def test_drawn(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("s"), F.col("id").cast("string").alias("k"))
    want = {"few": 30, "many": 40, "none": 5}
    first = {(r["s"], r["k"]) for r in paths.drawn(rows, "s", F.col("k"), want).collect()}
    again = {(r["s"], r["k"]) for r in paths.drawn(rows.repartition(7), "s", F.col("k"), want).collect()}
    assert first == again and sorted(s for s, _ in first) == ["few"] * 30 + ["many"] * 40
    assert {k for _, k in first} != {r["k"] for r in paths.drawn(rows, "s", F.col("k"), want, seed=7).collect()}
    assert paths.drawn(rows, "s", F.col("k"), {"few": 600}).count() == 500


def test_threshold_is_raised(spark, monkeypatch):
    """Keys whose hashes all are large leave too few below the first threshold."""
    monkeypatch.setattr(paths, "SPARE", 0)
    keys = spark.range(3000).select(F.lit("s").alias("s"), F.col("id").cast("string").alias("k")).withColumn("h", F.conv(F.substring(F.md5(F.concat(F.lit("42:"), "k")), 1, 12), 16, 10).cast("double") / float(1 << 48))
    assert paths.drawn(keys.where("h > 0.5").select("s", "k"), "s", F.col("k"), {"s": 20}).count() == 20


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 9000, True), ("b", "c", 8000, False), ("c", "a", 5000, True), ("c", "d", 3333, True), ("a", "a", 1, True)], "source string, target string, c4 long, actual boolean")
    got = {r["path"]: (r["hops"], r["c4"], r["actual"]) for r in paths.labelled_paths(edges).collect()}
    assert got["a > b > c > d"] == ("3", 2400, False) and got["c > a > b"] == ("2", 4500, True) and "a > b > c > a" not in got and "a > a" not in got


def test_numbering(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(9)
    assert sorted((r["place"], r["x"]) for r in numbered(rows, "x").collect()) == [(i + 1, i) for i in range(1000)]
    assert numbered(rows.limit(0), "x").collect() == []
    left, right = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "i long, v string"), spark.createDataFrame([(30, 1.0), (10, 2.0), (20, 3.0)], "j long, w double")
    assert {(r["v"], r["w"]) for r in zipped(left, right, "i", "j").collect()} == {("a", 2.0), ("b", 3.0), ("c", 1.0)}
    with pytest.raises(ValueError, match="3 and 2"):
        zipped(left, right.limit(2), "i", "j")


def test_reports(spark):
    nodes = spark.createDataFrame([("table:t", "table", "t"), *[(f"f{i}", "function", f"fn{i:02}") for i in range(20)], ("x", "file", "x.py")], "id string, type string, name string")
    edges = spark.createDataFrame([(i, f"f{i}", "table:t", "orm_call", 9800 - i) for i in range(20)] + [(50, "f0", "x", "structural_belongs_to", 10000), (51, "gone", "table:t", "declared_fk", 10000)], "seq long, source string, target string, type string, c4 long")
    roots = spark.createDataFrame([("table:t",), ("nothing",)], "root string")
    reached = graph.blast_radius(graph.propagation(edges), roots, 2)
    spots = spark.createDataFrame([("cross_service_boundary", "medium", 0)], "kind string, severity string, n long")
    got = {r["root"]: r["report"].split("\n") for r in reports.impact_reports(roots, reached, nodes, spots).collect()}
    assert got["nothing"] == ["Impact of nothing [unknown]", "0 affected: 0 functions, 0 files, 0 tables", "Not visible:", "  MEDIUM cross_service_boundary: 0"]
    lines = got["table:t"]
    assert lines[1] == "22 affected: 20 functions, 1 files, 0 tables" and lines[3] == "  MEDIUM fn00, via ORM call, hop 1" and lines[18] == "  and 5 more" and "Files:" in lines and "  and 1 more" in lines
    tables = spark.createDataFrame([("t", "table:t", 22, True), ("u", None, 0, False)], "name string, root string, total long, high_risk boolean")
    changed = spark.createDataFrame([(f"p{i:02}",) for i in range(17)], "path string")
    sections = [r["section"] for r in reports.change_report(changed, tables, reached, nodes, spots).orderBy("place").collect()]
    assert len(sections) == 4 and "- and 2 more files" in sections[0] and "**2** affected tables, **22** impacted" in sections[0]
    assert "<details><summary>10 more</summary>" in sections[1] and sections[1].count("| function |") == 20 and sections[2] == "### `u`: 0\nNothing depends on it." and sections[3].startswith("## Not visible")


def test_second_dialect(spark):
    edges = spark.createDataFrame([(0, "f", "t", "orm_call", 9000), (1, "p", "t", "declared_fk", 10000), (2, "x", "p", "declared_fk", 10000), (3, "y", "x", "declared_fk", 10000)], "seq long, source string, target string, type string, c4 long")
    nodes = spark.createDataFrame([("t", "table", "T"), ("p", "partition", "P"), ("f", "function", "F")], "id string, type string, name string")
    reached = graph.blast_radius(graph.propagation(edges), spark.createDataFrame([("t",)], "root string"), 3)
    got = {r["node"]: (r["type"], r["name"], r["listed"]) for r in graph.named_ends(reached, nodes, edges).collect()}
    assert got == {"f": ("function", "F", "functions"), "p": ("partition", "P", None), "x": ("file", "x", "files"), "y": ("file", "y", "files")}
    assert tuple(graph.tree_counts(nodes, edges).first()) == (3, 4, 0, 0) and graph.tree_counts(nodes, edges.limit(0)).first()["dynamic_tenths"] == 0


def test_sample_in_passes(spark, monkeypatch):
    """However many passes there are, and whether or not ids have kinds, the sample is the one of all paths at once."""
    from radiograph.plans import lineage

    links = [(f"l:{i}", f"o:{i % 60}", 9000 + i % 7, i % 3 > 0) for i in range(300)] + [(f"o:{i}", f"c:{i % 9}", 8000 + i, i % 5 > 0) for i in range(60)] + [(f"c:{i}", f"n:{i % 2}", 10000, True) for i in range(9)] + [("c:1", "c:1", 1, True), ("n:0", "l:3", 5000, True)]
    edges = spark.createDataFrame(links, "source string, target string, c4 long, actual boolean")
    most = {"1": 20, "2": 30, "3": 25}
    want = {(r["hops"], r["path"], r["c4"] / 10000, int(r["actual"])) for r in paths.drawn(paths.labelled_paths(edges), "hops", F.col("path"), most).collect()}
    sample = lambda: {(r["hops"], r["path"], r["p"], r["actual"]) for r in paths.path_sample(edges, most).collect()}
    assert len(want) == 75 and sample() == want
    monkeypatch.setattr(lineage, "PASS_ROWS", 100)
    assert sample() == want
    monkeypatch.setattr(lineage, "KINDS", 1)
    assert sample() == want


def test_reached_in_parts(spark, monkeypatch):
    """Parts by node hold together what one traversal finds, whatever their number and whether or not ids have kinds."""
    from radiograph.plans import lineage

    links = [(i, f"l:{i}", f"o:{i % 60}", "declared_fk", 10000) for i in range(300)] + [(1000 + i, f"l:{i % 200}", f"s:{i % 7}", "inferred_naming", 8000 + i % 5) for i in range(400)]
    links += [(2000 + i, f"o:{i}", f"c:{i % 9}", "orm_call", 9800) for i in range(60)] + [(3000 + i, f"c:{i}", f"n:{i % 2}", "declared_fk", 10000) for i in range(9)] + [(4000 + i, f"s:{i}", f"n:{i % 2}", "inferred_naming", 9200) for i in range(7)]
    links += [(5000, "s:1", "l:5", "structural_belongs_to", 10000), (5001, "n:0", "n:1", "other", 9000), (5002, "n:1", "n:0", "other", 9000)]
    edges = spark.createDataFrame(links, "seq long, source string, target string, type string, c4 long")
    roots = spark.createDataFrame([("n:0",), ("n:1",), ("s:3",), ("gone",)], "root string")
    rows = lambda df: sorted(map(repr, df.select("root", "node", "c4", "depth", "types", "path").collect()))
    for depth, least in ((1, 0), (3, 7500)):
        want = rows(graph.blast_radius(graph.propagation(edges), roots, depth, least))
        for most, kinds in ((10**8, 1000), (150, 1000), (150, 1)):
            monkeypatch.setattr(lineage, "PASS_ROWS", most)
            monkeypatch.setattr(lineage, "KINDS", kinds)
            parts = [rows(df) for df, _ in graph.reached_parts(edges, roots, depth, least)]
            assert sorted(r for p in parts for r in p) == want and (len(parts) > 1) == (most == 150)
