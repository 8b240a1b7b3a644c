"""Components of few edges take few tasks, however many partitions a shuffle has."""

import pytest

from radiograph.llm import common


def _chains(n, length):
    return [(length * i + k, length * i + k + 1) for i in range(n) for k in range(length - 1)]


@pytest.mark.parametrize("most", [common.BROADCAST_ROWS, 10])
def test_few_edges_take_few_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    edges = [*_chains(7, 20), *((1_000, 1_001 + i) for i in range(300)), (5, 5), (None, 3)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(f"components-{most}", "")
        got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {n: n // 20 * 20 for n in range(140)} | {1_000 + i: 1_000 for i in range(301)}
    if most > 10:
        seen = spark.sparkContext.statusTracker()
        jobs = [seen.getJobInfo(i) for i in seen.getJobIdsForGroup(f"components-{most}")]
        ran = [x.numCompletedTasks for s in {s for j in jobs for s in j.stageIds} if (x := seen.getStageInfo(s))]
        assert sum(x >= 16 for x in ran) <= 4
