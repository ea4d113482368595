"""Append-only records: an audit ledger, run reports, cached readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Rows (id, recorded_at, action, payload) in a folder of Parquet files; each append is one commit, rows are never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame) -> None:
        entries.select("id", "recorded_at", "action", "payload").write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema("id string, recorded_at timestamp, action string, payload string").parquet(self.path)

    def recent(self, limit: int = 10) -> DataFrame:
        """The newest rows first, of equally new ones the larger id; a task passes on ``limit`` rows at most."""
        return self.read().orderBy(F.desc("recorded_at"), F.desc("id")).limit(limit)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports (run_id, report_type, started_at, body) as JSON lines, a folder per type."""
    reports.write.partitionBy("report_type").mode("append").json(path)


def read_reports(spark: SparkSession, path: str, report_type: str | None = None) -> DataFrame:
    """Reports of a folder, of one type if asked; lines that do not parse are skipped."""
    rows = spark.read.schema("run_id string, started_at timestamp, body string, report_type string").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("report_type") == report_type) if report_type else rows


def scanned(reports: DataFrame, now: Column, days: float) -> DataFrame:
    """Reports newer, by run id, than the newest of those that started before ``now`` less ``days``; all if ``days`` is 0."""
    if days <= 0:
        return reports
    old = reports.where(F.col("started_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86_400.0))).agg(F.max("run_id").alias("_old"))
    return reports.join(F.broadcast(old), F.col("_old").isNull() | (F.col("run_id") > F.col("_old"))).drop("_old")  # one row


def readings(spark: SparkSession, path: str) -> DataFrame:
    """(key, reading) of a JSON-lines cache; the last row of a key wins, rows without a key and torn lines are skipped.

    Files count in the order of their names, rows in that of their places. A null reading is ``{}``.
    """
    parsed = spark.read.schema("key string, reading string").option("mode", "DROPMALFORMED").json(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    rows = parsed.select("key", F.coalesce("reading", F.lit("{}")).alias("reading"), place.alias("_at"))
    return rows.where("key IS NOT NULL").groupBy("key").agg(F.max_by("reading", "_at").alias("reading"))
