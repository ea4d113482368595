"""Reports on runs, clusters and answers: windows, summaries, verdicts and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arboryx.functions import scalar


def in_window(reports: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Reports of the last ``days`` days before ``now``; all with 0 days."""
    return reports if days == 0 else reports.where(F.col(at) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def newest_of_type(reports: DataFrame, kind: str, run: str, keep: int = 1) -> DataFrame:
    """The ``keep`` newest reports of each type, by run id."""
    order = Window.partitionBy(kind).orderBy(F.desc(run))
    return reports.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def blind_spots(stubs: DataFrame, least: int = 3) -> DataFrame:
    """(region, hits, strength, dominant): groups of at least ``least`` failed queries.

    ``stubs`` is (region, strength, cluster). The strength is the mean one, held in 0 to 1; dominant is the
    most frequent cluster, the smaller one in a tie; null clusters are none.
    """
    hits = stubs.groupBy("region").agg(F.count("*").alias("hits"), scalar.clamp(F.avg("strength")).alias("strength")).where(F.col("hits") >= least)
    votes = stubs.where("cluster is not null").groupBy("region", "cluster").agg(F.count("*").alias("n"))
    first = Window.partitionBy("region").orderBy(F.desc("n"), "cluster")
    dominant = votes.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("region", F.col("cluster").alias("dominant"))
    return hits.join(dominant, "region", "left")


def most_cited(observations: DataFrame, most: int = 10) -> DataFrame:
    """(region, id, times, place): the ids that a region's observations (region, cited array) cite most."""
    cited = observations.select("region", F.explode("cited").alias("id")).groupBy("region", "id").agg(F.count("*").alias("times"))
    order = Window.partitionBy("region").orderBy(F.desc("times"), "id")
    return cited.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def findings_in_order(findings: DataFrame, severities: tuple[str, ...], most: int = 50) -> DataFrame:
    """The first ``most`` findings (id, type, severity) by severity, the last named being the gravest, then type and id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity"))
    return findings.orderBy(F.desc(rank), "type", "id").limit(most)


def tier_summary(resolutions: DataFrame, by: str) -> DataFrame:
    """(by, resolved, tiers map, low_share): how often each tier resolved, and the share of tiers 0 and 1; 0 of none."""
    known = F.count("tier")
    counts = [F.count_if(F.col("tier") == i).alias(f"tier{i}") for i in range(5)]
    return resolutions.groupBy(by).agg(known.alias("resolved"), *counts, (F.count_if(F.col("tier") <= 1) / F.greatest(known, F.lit(1))).alias("low_share"))


def coverage(answers: DataFrame, kind: str = "kind") -> DataFrame:
    """Coverage, recall and end-to-end recall by kind, and of all as "all".

    ``answers`` is (kind, expected, present, retrieved), counts per question. A measure over nothing is 0.
    """
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    full = F.count_if((F.col("present") > 0) & (F.col("retrieved") == F.col("present")))
    rolled = answers.rollup(kind).agg(
        F.count("*").alias("questions"), share("present", "expected").alias("coverage"), share("retrieved", "present").alias("recall"),
        share("retrieved", "expected").alias("end_to_end"), full.alias("answered"), F.grouping(kind).alias("_all"),
    )
    return rolled.withColumn(kind, F.when(F.col("_all") == 1, "all").otherwise(F.col(kind))).drop("_all")


def sides_recall(sides: DataFrame, by: str) -> DataFrame:
    """(by, questions, both, any, mean): how many of a question's sides (question, found boolean) an answer has."""
    per = sides.groupBy(by, "question").agg(F.every("found").alias("both"), F.some("found").alias("any"), F.count_if("found").alias("n"))
    return per.groupBy(by).agg(F.count("*").alias("questions"), F.avg(F.col("both").cast("int")).alias("both"), F.avg(F.col("any").cast("int")).alias("any"), F.avg("n").alias("mean"))


def seeding_diagnostics(rows: DataFrame) -> DataFrame:
    """Retention, rescue and exclusive hits of one method against another.

    ``rows`` is (question, gold array, before array, after array). Retained are golds that both find, of
    those found before; rescued are golds only found after, of those missed before.
    """
    both = F.size(F.array_intersect("gold", F.array_intersect("before", "after")))
    had, missed = F.size(F.array_intersect("gold", "before")), F.size(F.array_except("gold", "before"))
    won = F.size(F.array_except(F.array_intersect("gold", "after"), F.col("before")))
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    told = rows.select(both.alias("both"), had.alias("had"), missed.alias("missed"), won.alias("won"))
    return told.agg(F.count("*").alias("questions"), share("both", "had").alias("retention"), share("won", "missed").alias("rescue"), F.sum("won").alias("exclusive_after"), (F.sum("had") - F.sum("both")).alias("exclusive_before"))


def rater_agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, the share within one step of each other, both means."""
    return pairs.agg(F.count("*").alias("pairs"), F.avg((F.abs(F.col(a) - F.col(b)) <= 1).cast("int")).alias("within_one"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))


def first_and_last_window(rewards: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """(by, first, last, gain): mean of the first and of the last ``size`` rewards of each run."""
    up, down = Window.partitionBy(by).orderBy(*order), Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    told = rewards.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)})
    mean = lambda c: F.avg(F.when(F.col(c) <= size, F.col("reward")))
    return told.groupBy(by).agg(mean("_a").alias("first"), mean("_b").alias("last")).withColumn("gain", F.col("last") - F.col("first"))


def type_groups(results: DataFrame, pools: dict[str, list[str]]) -> DataFrame:
    """(name, place, types, questions): each question type by its number of questions, then the pools of types.

    ``results`` is (question, type). A pool that bears a type's name is an error.
    """
    counts = results.where("type is not null").groupBy("type").agg(F.countDistinct("question").alias("questions"))
    named = [t for types in pools.values() for t in types]
    if set(pools) & set(named) or (pools and not counts.where(F.col("type").isin(list(pools))).isEmpty()):
        raise ValueError("a pool bears the name of a question type")
    rows = counts.select(F.col("type").alias("name"), F.lit(0).alias("_p"), "type", "questions")
    for i, (name, types) in enumerate(pools.items()):
        rows = rows.unionByName(counts.where(F.col("type").isin(types)).select(F.lit(name).alias("name"), F.lit(i + 1).alias("_p"), "type", "questions"))
    grouped = rows.groupBy("name", "_p").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("questions").alias("questions"))
    order = Window.orderBy("_p", F.desc("questions"), "name")  # a row per type and pool: question types are a fixed few
    return grouped.select("name", F.row_number().over(order).alias("place"), "types", "questions")


def connectivity_anomalies(metrics: DataFrame) -> DataFrame:
    """Adds ``anomalies`` to (largest_share, isolated, cross_links): fragmented under 0.75, over three isolated nodes, no link across."""
    some = F.array(
        F.when(F.col("largest_share") < 0.75, "fragmented"),
        F.when(F.col("isolated") > 3, "isolated nodes"),
        F.when(F.col("cross_links") == 0, "no cross links"),
    )
    return metrics.withColumn("anomalies", F.array_join(F.array_compact(some), "; "))


def crossing(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``crosses``: both ends have a cluster, and not the same; ``clusters`` is (id, cluster)."""
    a, b = clusters.select(F.col("id").alias("src"), F.col("cluster").alias("_a")), clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("_b"))
    return edges.join(a, "src", "left").join(b, "dst", "left").withColumn("crosses", F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))).drop("_a", "_b")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    """(cluster, size, place, mean): clusters by size, the largest first, beside the mean size."""
    sizes = assigned.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.avg("size").alias("mean"))))  # one row


def due(last_run: Column, now: Column, days: float, forced: Column | bool = False) -> Column:
    """Whether the interval since the last run is over; without a last run it is."""
    elapsed = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_run.cast("timestamp"))) / 86_400_000_000.0
    return F.lit(forced) | last_run.isNull() | (elapsed >= days)


def demoted(nodes: DataFrame, findings: DataFrame, severities: tuple[str, ...] = ("medium", "high", "critical"), step: float = 0.1) -> DataFrame:
    """``nodes`` with ``confidence`` lowered by one step, 0 at least, where a finding (id, severity) is grave enough."""
    hit = findings.where(F.col("severity").isin(list(severities))).select("id", F.lit(True).alias("_hit")).distinct()
    low = F.greatest(F.lit(0.0), F.col("confidence") - step)
    return nodes.join(hit, "id", "left").withColumn("confidence", F.when(F.col("_hit"), low).otherwise(F.col("confidence"))).drop("_hit")


def resolved(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions (id, external_id) on nodes (id, external_id, tier, pending): an external id gives tier 1, either clears the flag."""
    d = decisions.select("id", F.col("external_id").alias("_e"), F.lit(True).alias("_d"))
    out = nodes.join(d, "id", "left")
    return out.withColumns({
        "external_id": F.coalesce("_e", "external_id"),
        "tier": F.when(F.col("_e").isNotNull(), 1).otherwise(F.col("tier")),
        "pending": F.when(F.col("_d"), False).otherwise(F.col("pending")),
    }).drop("_e", "_d")


def marked_once(nodes: DataFrame, marks: DataFrame, column: str) -> DataFrame:
    """``nodes`` with the runs of ``marks`` (id, run) added to an array column, each once, in order."""
    runs = marks.groupBy("id").agg(F.array_sort(F.collect_set("run")).alias("_runs"))
    return nodes.join(runs, "id", "left").withColumn(column, F.array_union(F.col(column), F.coalesce("_runs", F.array().cast("array<string>")))).drop("_runs")


def unit_vector_of(name: Column, dim: int, salt: str = "") -> Column:
    """A deterministic unit vector of a text: sha256 over salt, text and a counter, four bytes a component, little end first."""
    blocks = -(-dim // 8)
    counter = lambda i: F.unhex(F.lit(int(i).to_bytes(4, "little").hex()))
    seed = F.concat(F.lit(f"{salt}::"), name).cast("binary")
    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  ``f`` of a value that is worked out once, not in every step of a lambda

    def components(digits: Column) -> Column:
        octet = lambda i, j: F.substring(digits, i * 8 + F.lit(7 - 2 * j), F.lit(2))  # noqa: E731  bytes 4, 3, 2, 1
        number = lambda i: F.conv(F.concat(*[octet(i, j) for j in range(4)]), 16, 10).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: number(i) / 2.0**32 * 2 - 1)

    def unit(raw: Column) -> Column:
        length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
        return once(length, lambda n: F.transform(raw, lambda x: F.when(n == 0, 0.0).otherwise(x / n)))

    digits = once(seed, lambda s: F.concat(*[F.sha2(F.concat(s, counter(i)), 256) for i in range(blocks)]))
    return once(digits, lambda d: once(components(d), unit))
