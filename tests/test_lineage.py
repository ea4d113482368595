"""What stored tables and rounds leave behind: shuffle files and tasks."""

import time

from pyspark.sql import functions as F

from arboryx.lineage import CLEANUP, cut
from arboryx.operators import graph


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    rows, before, kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), shuffle_files(spark), spark.conf.get(CLEANUP, None)
    stored = cut(rows)
    for _ in range(50):  # they go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) == kept
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect())) == sorted(map(tuple, rows.collect()))


def test_few_edges_take_few_tasks_and_give_the_same_components(spark, monkeypatch):
    chain = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + F.when(F.col("id") % 20 == 19, 0).otherwise(1)).alias("dst"))
    sc, found, tasks = spark.sparkContext, [], []
    monkeypatch.setattr(graph, "FEW_EDGES", graph.FEW_EDGES)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for most in (graph.FEW_EDGES, 0):
            monkeypatch.setattr(graph, "FEW_EDGES", most)
            sc.setJobGroup(f"components {most}", "")
            found.append(sorted(map(tuple, graph.components(chain).collect())))
            jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"components {most}")]
            stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in j.stageIds]
            tasks.append(sum(s.numCompletedTasks for s in stages if s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == [(i, i // 20 * 20) for i in range(40)]
    assert tasks[0] < tasks[1] / 2
