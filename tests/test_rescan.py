"""The incremental re-scan, run stream by stream over a growing folder of files."""

from datetime import datetime

from pyspark.sql import functions as F

from radiograph.functions import names
from radiograph.streaming.rescan import current, rescan

SCHEMA = "path string, content string, changed timestamp"


def references(files):
    return files.select("path", "version", F.explode(names.sql_tables(F.col("content"))).alias("table_name"))


def run(spark, folder, rows):
    spark.createDataFrame([(p, c, datetime(2024, 1, 1, 0, m)) for p, c, m in rows], SCHEMA).write.mode("append").parquet(f"{folder}/in")
    rescan(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), references, f"{folder}/out").awaitTermination()
    return {(r["path"], r["table_name"]) for r in current(spark, f"{folder}/out").collect()}


def test_rescan(spark, tmp_path):
    first = [("a.py", "select 1 from users join orders", 1), ("b.py", "select 1 from items", 1), ("c.py", "nothing", 1), (None, "from x", 1)]
    assert run(spark, tmp_path, first) == {("a.py", "users"), ("a.py", "orders"), ("b.py", "items")}
    assert run(spark, tmp_path, [("a.py", "from old", 2), ("a.py", "from people", 3), ("b.py", None, 4)]) == {("a.py", "people")}
    assert run(spark, tmp_path, [("b.py", "from things", 5), ("a.py", "", 6)]) == {("b.py", "things")}
