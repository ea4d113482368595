"""Answers of the first generation: codebook activation, the edges among what it found, and a text without a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arboryx.lineage import cut

from . import graph, ranking

#: Below this score of the best node a question has no strong match.
STRONG_MATCH = 0.3


def scored(energy: DataFrame, k: int = 10, least: float = 0.3) -> DataFrame:
    """(query_id, id, score, rank): the k nodes of the most energy (query_id, id, x), as shares of the most, from ``least`` up."""
    most = energy.groupBy("query_id").agg(F.max("x").alias("_most"))
    share = F.when(F.col("_most") > 1e-12, F.col("x") / F.col("_most")).otherwise(0.0)
    few = ranking.top(energy, ["query_id"], [F.desc("x"), F.col("id")], k)
    told = few.join(most, "query_id").withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))
    return told.where(F.col("score") >= least).select("query_id", "id", "score", "rank")


def retrieve(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 10, hops: int = 2, least: float = 0.3) -> DataFrame:
    """(query_id, id, score, rank) for ``queries`` (query_id, v): the nearest min(k, 64) nodes (id, v) are touched by their cosine, what is
    below 0 not at all, and activation spreads over ``edges`` (src, dst, weight, strength, match) in 1 to 8 hops."""
    if k <= 0:
        raise ValueError(f"k must be positive; got {k}")
    asked = queries.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), "v")
    named = nodes.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "v")  # a query's own id is no node's
    near = ranking.nearest(named, asked, min(k, 64)).where("cosine > 0")
    kinds = dict(nodes.dtypes)["id"], dict(queries.dtypes)["query_id"]
    bare = lambda c, kind: F.substring(c, 2, 2**31 - 1).cast(kind)
    seeds = cut(near.select(bare("query_id", kinds[1]).alias("query_id"), bare("id", kinds[0]).alias("id"), F.col("cosine").alias("x")))
    energy = graph.codebook_spread(edges, seeds, hops=max(1, min(hops, 8)))
    return scored(energy.withColumn("x", F.round("x", 12)), k, least)


def assembled(found: DataFrame, nodes: DataFrame, edges: DataFrame, strong: float = STRONG_MATCH) -> dict[str, DataFrame]:
    """What ``found`` (query_id, id, score, rank) makes of nodes (id, label, confidence, description, source_type, identifier, location) and edges (src, dst, rel, weight).

    ``nodes`` in their rank; ``edges`` with both ends among them, each (src, dst, rel) once, the heaviest; ``sources``
    (query_id, place, source_type, identifier), each once in the order of the nodes; ``gaps``: whether even the best node is no strong match.
    """
    told = cut(found.join(nodes, "id"))
    ends = lambda side: found.select("query_id", F.col("id").alias(side))
    among = edges.join(ends("src"), "src").join(ends("dst"), ["query_id", "dst"]).groupBy("query_id", "src", "dst", "rel").agg(F.max("weight").alias("weight"))
    sources = told.groupBy("query_id", "source_type", F.coalesce("identifier", F.lit("")).alias("identifier")).agg(F.min("rank").alias("_first"))
    placed = sources.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_first"))).drop("_first")
    gaps = found.groupBy("query_id").agg(F.max("score").alias("best")).select("query_id", F.when(F.col("best") < strong, "no_strong_match").otherwise("").alias("gaps"))
    return {"nodes": told, "edges": among, "sources": placed, "gaps": gaps}


def offline_answer(told: DataFrame, queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, text, cited): a list of the ``most`` most certain nodes that a query found, with their sources and descriptions.

    ``told`` is (query_id, id, rank, label, confidence, description, identifier, location). Nothing is generated; queries that
    found nothing say so and cite nothing. Equal confidences keep the order of the ranks.
    """
    few = ranking.top(told, ["query_id"], [F.desc("confidence"), F.col("rank")], most, "place")
    where = F.concat(F.coalesce("identifier", F.lit("unknown source")), F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit(" ("), "location", F.lit(")"))).otherwise(""))
    line = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] "), "label", F.lit(" — "), where, F.lit(" (confidence "), F.format_string("%.2f", F.col("confidence")), F.lit(")"))
    more = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n  "), F.replace("description", F.lit("\n"), F.lit("\n  ")))).otherwise("")
    gathered = few.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(line, more).alias("line"), F.col("id").cast("string").alias("id")))).alias("l"))
    out = queries.select("query_id").distinct().join(gathered, "query_id", "left")
    head = F.concat(F.lit("No language model: the "), F.size("l").cast("string"), F.lit(" most certain nodes found, as they are stored.\n"))
    text = F.when(F.col("l").isNull(), "No language model, and no node was found.").otherwise(F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    return out.select("query_id", text.alias("text"), F.coalesce(F.transform("l", lambda x: x["id"]), F.array().cast("array<string>")).alias("cited"))
