"""Edges made from contents: co-occurrence, mentions, hierarchy and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arboryx.functions import text, vectors


def co_occurring(members: DataFrame) -> DataFrame:
    """(src, dst, groups): ordered pairs of different items of a group, both directions, and in how many groups.

    ``members`` is (grp, item). Pairs of one group are counted before they are shuffled.
    """
    m = members.select("grp", "item").distinct()
    half = m.alias("a").join(m.alias("b"), "grp").where("a.item < b.item").groupBy(F.col("a.item").alias("src"), F.col("b.item").alias("dst")).agg(F.count("*").alias("groups"))
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "groups"))


def bridged(chosen: DataFrame, mentions: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, rank, passage, overlap): passages by how many of a query's chosen entities they mention.

    ``chosen`` is (query_id, id, rank), ``mentions`` (id, chunk) with chunks named "...#p<number>". Ties
    go to the passage that the best ranked entity mentions, then to the smaller number.
    """
    passage = F.regexp_extract("chunk", "#p(\\d+)$", 1)
    refs = mentions.select("id", passage.alias("passage")).where("passage <> ''").select("id", F.col("passage").cast("long").alias("passage")).distinct()
    hit = chosen.join(refs, "id").groupBy("query_id", "passage").agg(F.countDistinct("id").alias("overlap"), F.min("rank").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "first", "passage")
    return hit.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "rank", "passage", "overlap")


def part_of(sections: DataFrame, documents: DataFrame, weight: float = 0.9) -> DataFrame:
    """(src, dst, rel, weight): each section (id, path) into the document (id, path) of its path."""
    owners = documents.select(F.col("id").alias("dst"), "path")
    return sections.select(F.col("id").alias("src"), "path").join(owners, "path").select("src", "dst", F.lit("part_of").alias("rel"), F.lit(weight).alias("weight"))


def crosslinks(near: DataFrame, share: float = 0.03, floor: float = 0.5) -> DataFrame:
    """(src, dst, score): of each new node's neighbours the best ``share``, one at least, none below ``floor``.

    ``near`` is (query_id, id, cosine, rank); the score of a neighbour is one half of one plus the cosine.
    """
    found = near.groupBy("query_id").agg(F.count("*").alias("_n"))
    kept = near.join(found, "query_id").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)))
    return kept.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), ((1 + F.col("cosine")) / 2).alias("score")).where(F.col("score") >= floor)


def implicit_edges(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, v): an edge to each neighbour, its vector the mean of both ends'; ``nodes`` is (id, v)."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("v").alias("_a")), nodes.select(F.col("id").alias("dst"), F.col("v").alias("_b"))
    pairs = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", vectors.midpoint(F.col("_a"), F.col("_b")).alias("v"))


def graph_inputs(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What extractions give a graph: (passage, label) and (a, b, count).

    ``entities`` is (passage, label), ``relations`` (passage, src, dst) by label. Labels are normalised, those
    under two characters go; a relation needs both ends among its passage's entities and two of
    them; relations have no direction.
    """
    form = lambda c: text.entity_form(F.col(c))
    known = entities.select("passage", form("label").alias("label")).where(F.length("label") >= 2).distinct()
    ends = relations.select("passage", form("src").alias("src"), form("dst").alias("dst")).where("src <> dst")
    held = ends.join(known.withColumnRenamed("label", "src"), ["passage", "src"], "left_semi").join(known.withColumnRenamed("label", "dst"), ["passage", "dst"], "left_semi")
    return known, held.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("count"))


def merged_seeds(*seeds: DataFrame) -> DataFrame:
    """(query_id, id, x): the larger of a node's weights among several kinds of seeds."""
    out = seeds[0].select("query_id", "id", "x")
    for s in seeds[1:]:
        out = out.unionByName(s.select("query_id", "id", "x"))
    return out.groupBy("query_id", "id").agg(F.max("x").alias("x"))


def seeds_by_pool(near: DataFrame, mode: str = "passage", s: int = 5) -> DataFrame:
    """(query_id, id, x): the nearest ``s`` of each pool that ``mode`` takes, weighing their cosine, 0 at least.

    ``near`` is (query_id, id, pool, cosine) with the pools "passage" and "entity"; "hybrid" takes both.
    """
    if mode not in ("passage", "entity", "hybrid"):
        raise ValueError(f"no such mode of seeding: {mode!r}")
    pools = near if mode == "hybrid" else near.where(F.col("pool") == mode)
    order = Window.partitionBy("query_id", "pool").orderBy(F.desc("cosine"), "id")
    return pools.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= s).select("query_id", "id", F.greatest("cosine", F.lit(0.0)).alias("x"))


def seed_touching(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, place): seeds in their order, then the other ends of their edges as these come.

    ``seeds`` is (query_id, id, rank), ``edges`` (query_id, a, b, rank).
    """
    ends = edges.select("query_id", F.col("a").alias("id"), F.col("b").alias("other"), "rank").union(edges.select("query_id", "b", "a", "rank"))
    known = seeds.select("query_id", "id")
    touched = ends.join(known, ["query_id", "id"], "left_semi").select("query_id", F.col("other").alias("id"), "rank")
    others = touched.join(known, ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    every = seeds.select("query_id", "id", F.lit(0).alias("kind"), "rank").unionByName(others.select("query_id", "id", F.lit(1).alias("kind"), "rank"))
    order = Window.partitionBy("query_id").orderBy("kind", "rank", "id")
    return every.select("query_id", "id", F.row_number().over(order).alias("place"))


def strongest_unseen(edges: DataFrame, active: DataFrame, k: int = 3) -> DataFrame:
    """(session, id, weight): per session the targets one hop from what is active and not active themselves."""
    hop = active.select("session", F.col("id").alias("src")).join(edges, "src").select("session", F.col("dst").alias("id"), "weight")
    fresh = hop.join(active.select("session", "id"), ["session", "id"], "left_anti").groupBy("session", "id").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("session").orderBy(F.desc("weight"), "id")
    return fresh.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def local_classes(candidates: DataFrame, value: str, n_classes: int = 4) -> DataFrame:
    """Adds ``weight_class``, 0 to n_classes - 1, by the exact quantiles of each query's own candidates; a value on a cut is above it."""
    cuts = candidates.groupBy("query_id").agg(F.percentile(value, F.array(*[F.lit(i / n_classes) for i in range(1, n_classes)])).alias("_p"), F.count("*").alias("_n"))
    above = F.size(F.filter("_p", lambda p: p <= F.col(value)))
    return candidates.join(cuts, "query_id").withColumn("weight_class", F.when(F.col("_n") == 1, 0).otherwise(above)).drop("_p", "_n")
