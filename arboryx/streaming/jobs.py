"""Streams over append-only logs: ticks, windows, quotas, working memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arboryx.operators import evolve
from arboryx.sources.versions import VersionedTable


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files at ``path`` (a folder, a file or a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Runs all that is there through ``write(batch, epoch)`` and stops; a restart goes on behind it."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def tick_writer(edges: VersionedTable, passes: DataFrame | None, lam: float = 0.05, most_out: int = 10_000):
    """A foreachBatch function: each micro-batch of deltas makes the next version of the edges.

    Epoch n writes version n + 1 from version n, so a batch that is tried again gives the same version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        before = edges.read(epoch)
        after = evolve.merge_deltas(before, batch)
        if passes is not None:
            after = evolve.decayed(after, evolve.fired(after, passes, batch), lam)
        edges.commit(evolve.saturated(after, most_out), epoch + 1)

    return write


def windowed_counts(events: DataFrame, length: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events per type and tumbling window; rows later than the watermark are dropped by Spark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def followed_by(first: DataFrame, then: DataFrame, within: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(user_id, first_id, then_id) of two streams of events: what a user did at the same time as the first or up to ``within`` after it.

    Both sides carry a watermark, so state older than lateness and interval is dropped, and so are rows later than that.
    """
    a = first.select("user_id", F.col("event_id").alias("first_id"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", lateness)
    b = then.select(F.col("user_id").alias("_user"), F.col("event_id").alias("then_id"), F.col("ts").cast("timestamp").alias("then_at")).withWatermark("then_at", lateness)
    near = (F.col("_user") == F.col("user_id")) & (F.col("then_at") >= F.col("at")) & (F.col("then_at") <= F.col("at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "first_id", "then_id")


def quotas(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Per user, windows that begin at their first event and end ``seconds`` later; events beyond the limit are refused.

    Returns (user_id, event_id, used, allowed). The windows are not aligned, hence the state: start and
    count, nothing more per user. Events are taken in the order of time within a micro-batch.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, event in zip(rows["at"].tolist(), rows["event_id"].tolist()):
            if not used or at - start >= seconds * 1_000_000:
                start, used = at, 0
            if used < limit:
                used += 1
                out.append((key[0], event, used, True))
            else:
                out.append((key[0], event, used, False))
        state.update((start, used))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "used", "allowed"])

    timed = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, used long, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout
    )


def working_memory(events: DataFrame, decay: float = 0.779, floor: float = 0.01, capacity: int = 200) -> DataFrame:
    """Per user, activations of event types: each step fades what was not just touched; the weakest half
    goes when the capacity is passed. Returns (user_id, step, concept, activation) of the latest state
    after each micro-batch.

    Activation follows from the steps since a concept was touched, so the state is the step of each one's last
    touch, oldest first, and nothing is faded in it: an event moves one concept to the end and drops those at
    the front that have faded below the floor or are too many, whatever the capacity is.
    """
    longest = 0
    while decay ** (longest + 1) >= floor and longest < 100_000:
        longest += 1

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, touched, n = state.get if state.exists else ([], [], 0)
        held = dict(zip(names, touched))  # in the order of the last touch
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for concept in rows["event_type"].tolist():
            n += 1
            held.pop(concept, None)
            held[concept] = n
            while n - held[oldest := next(iter(held))] > longest:
                del held[oldest]
            if len(held) > capacity:
                while len(held) > max(1, capacity // 2):
                    del held[next(iter(held))]
        state.update((list(held), list(held.values()), n))
        yield pd.DataFrame({"user_id": key[0], "step": n, "concept": list(held), "activation": [decay ** (n - x) for x in held.values()]})

    timed = events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, step long, concept string, activation double", "names array<string>, touched array<long>, n long", "append", GroupStateTimeout.NoTimeout
    )


class LateRows:
    """A foreachBatch function that keeps what a watermark would drop: rows on time and late rows apart, and their numbers.

    A row is late if its time lies more than ``lateness`` before the latest one of all earlier micro-batches, as
    for Spark's own watermark. ``folder/on_time`` and ``folder/late`` have a folder per micro-batch, and a table of
    counts goes along, whose version n + 1 is made by batch n from version n: a batch that is tried again writes the same again.
    Rows without a time are late. Numbers are observed while the rows are written, not in a pass of their own.
    """

    SCHEMA = "epoch long, latest timestamp, on_time long, late long"

    def __init__(self, spark: SparkSession, folder: str, lateness: str = "2 hours", at: str = "ts"):
        self.spark, self.folder, self.lateness, self.at = spark, folder, lateness, at
        self.counts = VersionedTable(spark, f"{folder}/counts")
        if not self.counts.versions():
            self.counts.commit(spark.createDataFrame([], self.SCHEMA), 0)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self.counts.read(epoch)
        at = F.col(self.at).cast("timestamp")
        latest = before.agg(F.max("latest")).first()[0]
        limit = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}")
        late = at.isNull() | F.coalesce(at < limit, F.lit(False))
        seen = Observation()
        told = batch.withColumn("_late", late).observe(seen, F.count_if(~F.col("_late")).alias("on_time"), F.count_if("_late").alias("late"), F.max(at).alias("latest"))
        told.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").partitionBy("_late").parquet(f"{self.folder}/rows/batch={epoch}")
        n = seen.get
        last = max(x for x in (latest, n["latest"]) if x is not None) if latest is not None or n["latest"] is not None else None
        self.counts.commit(before.unionByName(self.spark.createDataFrame([(epoch, last, n["on_time"], n["late"])], self.SCHEMA)), epoch + 1)

    def rows(self, late: bool) -> DataFrame:
        """Rows of all micro-batches, with their ``epoch``, that were late, or that were not."""
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(f"{self.folder}/rows/batch=*").where(F.col("_late") == late).drop("_late", "batch")


def session_counts(events: DataFrame, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of a stream of events: sessions that a gap ends, emitted once the watermark has passed them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    counts = timed.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
