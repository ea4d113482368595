"""From activation to an answer: the strongest nodes, the edges among them, credit, gaps and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(activation: DataFrame, nodes: DataFrame, k: int = 50, anchors: int = 3, headroom: int = 16) -> DataFrame:
    """(query_id, id, x, rank, is_anchor): the k + headroom most active nodes, of which k content nodes and a few anchors stay."""
    order = Window.partitionBy("query_id").orderBy(F.desc("x"), "id")
    few = activation.where("x > 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + headroom)
    told = few.join(nodes.select("id", "is_anchor"), "id")
    kind = Window.partitionBy("query_id", "is_anchor").orderBy(F.desc("x"), "id")
    kept = told.withColumn("_k", F.row_number().over(kind)).where(F.col("_k") <= F.when(F.col("is_anchor"), anchors).otherwise(k))
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "x", "rank", "is_anchor")


def among(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, src, dst, rel, weight, xs, xt): edges with both ends among a query's chosen nodes."""
    a = chosen.select("query_id", F.col("id").alias("src"), F.col("x").alias("xs"))
    b = chosen.select("query_id", F.col("id").alias("dst"), F.col("x").alias("xt"))
    return edges.join(a, "src").join(b, ["query_id", "dst"]).select("query_id", "src", "dst", "rel", "weight", "xs", "xt")


def result_edges(edges: DataFrame, chosen: DataFrame, seeds: DataFrame, rank_of: Column, most: int = 200) -> DataFrame:
    """Undirected edges of a result: of each pair the best descriptor, then the larger weight; the first
    ``most`` by touching a seed, the weaker end's activation, descriptor rank and weight."""
    inside = among(edges, chosen).withColumn("rel_rank", rank_of)
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    best = F.max_by(F.struct("src", "dst", "rel", "weight", "rel_rank", F.least("xs", "xt").alias("low")), F.struct("rel_rank", "weight", "rel", "src"))
    one = inside.groupBy("query_id", *pair).agg(best.alias("e")).select("query_id", "a", "b", "e.rel", "e.weight", "e.rel_rank", "e.low")
    seed = seeds.select("query_id", "id").distinct()
    touched = one.select("query_id", "a", "b", F.explode(F.array("a", "b")).alias("id")).join(seed, ["query_id", "id"]).select("query_id", "a", "b", F.lit(True).alias("seed")).distinct()
    told = one.join(touched, ["query_id", "a", "b"], "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy(F.desc("seed"), F.desc("low"), F.desc("rel_rank"), F.desc("weight"), "a", "b")
    return told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hebbian(edges: DataFrame, chosen: DataFrame, rate: float = 0.01, most: int = 64) -> DataFrame:
    """(query_id, src, dst, rel, delta): credit for the result edges with the largest product of activations."""
    credit = among(edges, chosen).withColumn("delta", rate * F.col("xs") * F.col("xt"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("delta", 12)), "src", "dst", "rel")
    return credit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", "src", "dst", "rel", "delta")


def verdicts(chosen: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, nodes, edges, anchors, verdict, gaps): poor without nodes, partial without edges or anchors."""
    n = chosen.groupBy("query_id").agg(F.count("*").alias("nodes"), F.count_if("is_anchor").alias("anchors"))
    e = edges.groupBy("query_id").agg(F.count("*").alias("edges"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = queries.select("query_id").distinct().join(n, "query_id", "left").join(e, "query_id", "left").select("query_id", zero("nodes").alias("nodes"), zero("edges").alias("edges"), zero("anchors").alias("anchors"))
    verdict = F.when(F.col("nodes") == 0, "poor").when((F.col("edges") == 0) | (F.col("anchors") == 0), "partial").otherwise("good")
    gaps = F.array_compact(F.array(F.when(F.col("anchors") == 0, "no anchors"), F.when(F.col("edges") == 0, "no direct edges"), F.when(F.col("nodes") == 0, "empty")))
    return out.withColumns({"verdict": verdict, "gaps": F.array_join(gaps, "; ")})


def rendered(chosen: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, text): an entity line per node and a line per edge, in rank order."""
    lines = chosen.join(labels.select("id", "label"), "id").select("query_id", F.lit(0).alias("part"), "rank", F.format_string("%s (%s)", "label", "id").alias("line"))
    more = edges.select("query_id", F.lit(1).alias("part"), "rank", F.format_string("%s -%s- %s", "a", "rel", "b").alias("line"))
    gathered = lines.union(more).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", "rank", "line"))).alias("l"))
    return gathered.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
