"""State of a graph over time: merging logs, decay, renormalising, saturation, firing, life cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboryx.functions import scalar

KEY = ["src", "dst", "rel"]


def merge_deltas(edges: DataFrame, deltas: DataFrame, most: float = 1.0) -> DataFrame:
    """Edges (src, dst, rel, weight) with the positive deltas added, at most ``most``; new pairs become edges.

    Deltas are positive, so one sum and one clamp give what clamping after each would. A null relation
    is a key of its own. Duplicates of an edge count as their strongest.
    """
    base = edges.groupBy(*KEY).agg(F.max("weight").alias("weight"))
    gained = deltas.where("delta > 0").groupBy(*KEY).agg(F.sum("delta").alias("delta"))
    # a union and one aggregation instead of a full outer join: hot keys are combined before the shuffle
    both = base.select(*KEY, "weight", F.lit(0.0).alias("delta")).unionByName(gained.select(*KEY, F.lit(None).cast("double").alias("weight"), "delta"))
    merged = both.groupBy(*KEY).agg(F.max("weight").alias("weight"), F.sum("delta").alias("delta"))
    return merged.select(*KEY, F.least(F.lit(most), F.coalesce("weight", F.lit(0.0)) + F.col("delta")).alias("weight"))


def fired(edges: DataFrame, passes: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) of edges whose ends share a pass, or which a positive delta names; loops never.

    Each edge meets the passes of its source and looks for its target there: the pairs of a pass are
    never built.
    """
    ends = edges.select("src", "dst").where("src <> dst").distinct()
    touched = passes.select("pass_id", F.explode(F.array_distinct("node_ids")).alias("id"))
    with_source = ends.join(touched.withColumnRenamed("id", "src"), "src")
    both = with_source.join(touched.withColumnRenamed("id", "dst"), ["pass_id", "dst"], "left_semi").select("src", "dst")
    if deltas is not None:
        named = deltas.where("delta > 0 and src <> dst").select("src", "dst").distinct()
        both = both.unionByName(ends.join(named, ["src", "dst"], "left_semi"))
    return both.distinct()


def decayed(edges: DataFrame, spared: DataFrame, lam: float = 0.05, dt: float = 1.0) -> DataFrame:
    """Super-linear decay of all edges but the spared (src, dst)."""
    marked = edges.join(spared.select("src", "dst", F.lit(True).alias("_kept")), ["src", "dst"], "left")
    tier = F.col("decay_tier") if "decay_tier" in edges.columns else F.lit(0)
    weight = F.when(F.col("_kept"), F.col("weight")).otherwise(scalar.super_linear_decay(F.col("weight"), tier, lam, dt))
    return marked.withColumn("weight", weight).select(*edges.columns)


def renormalised(edges: DataFrame, target_mass: float, epsilon: float = 0.01) -> DataFrame:
    """All weights times target / mass, unless the drift is within epsilon."""
    mass = edges.agg(F.sum("weight").alias("_mass"))
    factor = F.when(F.abs(F.col("_mass") / target_mass - 1) <= epsilon, 1.0).otherwise(target_mass / F.col("_mass"))
    return edges.crossJoin(F.broadcast(mass)).withColumn("weight", F.col("weight") * factor).drop("_mass")  # one row


def renormalised_per_source(edges: DataFrame, before: DataFrame, softness: float = 0.0) -> DataFrame:
    """Weights of each source brought back to its earlier sum; ``softness`` moves factors towards one."""
    then = before.groupBy("src").agg(F.sum("weight").alias("_then"))
    now = edges.groupBy("src").agg(F.sum("weight").alias("_now"))
    factor = F.coalesce(F.col("_then") / F.nullif(F.col("_now"), F.lit(0.0)), F.lit(1.0))
    joined = edges.join(now, "src").join(then, "src", "left")
    return joined.withColumn("weight", F.col("weight") * (1 + (factor - 1) * (1 - softness))).select(*edges.columns)


def saturated(edges: DataFrame, most_out: int = 10_000, most_weight: float = 1.0) -> DataFrame:
    """The ``most_out`` strongest edges of each source, clipped; ties by target, then relation.

    Spark limits each group before the shuffle as well, so a hot source sends few rows.
    """
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst", "rel")
    return edges.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most_out).drop("_r").withColumn("weight", F.least("weight", F.lit(most_weight)))


def firing_fold(nodes: DataFrame, passes: DataFrame, keep: float = 0.9) -> DataFrame:
    """Nodes (id, fired_total, fired_recent, last_fired) after the passes; recent counts lose their fraction."""
    hits = passes.select("at", F.explode(F.array_distinct("node_ids")).alias("id")).groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = nodes.join(hits, "id", "left")
    hit = F.col("_n").isNotNull()
    return joined.select(
        "id",
        F.when(hit, F.col("fired_total") + F.col("_n")).otherwise(F.col("fired_total")).alias("fired_total"),
        F.when(hit, F.floor(F.col("fired_recent") * keep) + F.col("_n")).otherwise(F.col("fired_recent")).alias("fired_recent"),
        F.when(hit, F.greatest("last_fired", "_at")).otherwise(F.col("last_fired")).alias("last_fired"),
    )


def tick(edges: DataFrame, deltas: DataFrame, passes: DataFrame, lam: float = 0.05, most_out: int = 10_000, most: float = 1.0) -> DataFrame:
    """One substrate tick: merge the deltas, decay what did not fire, saturate. One lazy plan."""
    merged = merge_deltas(edges, deltas, most)
    return saturated(decayed(merged, fired(merged, passes, deltas), lam), most_out, most)


def life_cycle(nodes: DataFrame, promote: float = 0.7, degrade: float = 0.25, idle: float = 7.0) -> DataFrame:
    """Adds vitality and the verdict of a tick to nodes (confidence, relevance, degree, idle_days)."""
    connected, fresh = scalar.connectivity_linear(F.col("degree")), scalar.freshness_linear(F.col("idle_days"))
    vital = scalar.vitality(F.col("confidence"), F.col("relevance"), connected, fresh)
    verdict = F.when(F.col("vitality") >= promote, "promote").when((F.col("vitality") <= degrade) & (F.coalesce("idle_days", F.lit(0.0)) >= idle), "degrade").otherwise("keep")
    return nodes.withColumn("vitality", vital).withColumn("verdict", verdict)


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Whole rows of ``new`` in the place of, or beside, those of the table with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def update_known(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The table with the non-null fields of ``new``; keys that the table lacks are passed over."""
    fields = [c for c in new.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = table.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids of ``gone`` and every edge that touches one."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def latest(table: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; limits apply before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return table.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
