"""Seconds for the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from radiograph.plans import registry

HEADLINE = (
    "blast_radius_nation", "blast_radius_multi_root", "change_impact_summary", "parallel_edge_collapse", "resolve_target", "graph_metrics", "infer_naming", "candidate_names",
    "sql_table_refs", "cooccurrence_projection", "modularity_q", "path_suffix_match", "calibration_curve",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).count()
    took, known = {}, registry.queries()
    for name in HEADLINE:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
