"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by spark.checkpoint.dir.

    Where none is named, a temporary one is made if Spark runs on this machine alone; on a cluster
    that would leave each executor with a folder of its own, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


@contextmanager
def without_shuffle_files(spark: SparkSession):
    """Queries made and run in it leave no shuffle files; those of others stay until the driver collects its garbage.

    Only for queries that are run once: one that is run again would have to shuffle again.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from a reliable checkpoint in the shared folder; what it shuffled goes at once."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with without_shuffle_files(df.sparkSession):
        return df.select("*").checkpoint()  # a query of its own, since df may be run again


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, which has an order, with the number of each row (from 0) in it; no task sees more than its own range."""
    kept = cut(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).collect()  # a row per partition
    before, start = 0, {}
    for part, n, first in sorted(counts):
        start[part] = before - first
        before += n
    offset = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])[F.col("_part")] if start else F.lit(0)
    return kept.withColumn(name, (F.col("_at") + offset).cast("long")).drop("_part", "_at")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` as the broadcast side of a join if it has no more than ``rows`` rows, else as it is; it is counted, so store it before."""
    with without_shuffle_files(df.sparkSession):
        n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df
