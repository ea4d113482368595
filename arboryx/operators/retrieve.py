"""A whole retrieval: neighbours, seeds, activation, result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboryx.lineage import cut

from . import assemble, graph, ranking, seeding


def retrieve(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int = 50, k_seeds: int = 8, candidates: int = 64, operator: str = "ppr", lam: float = 0.6) -> dict[str, DataFrame]:
    """Nodes, edges and verdicts of all ``queries`` at once.

    ``nodes`` is (id, v unit vector, is_anchor), ``edges`` (src, dst, rel, weight) and ``queries``
    (query_id, v). The nearest nodes of a query become diversified seeds by weight classes over all nodes'
    in-strength; activation spreads from them. Without any edge the k nearest nodes are the result.
    """
    conducting = graph.conducting(edges)
    strength = nodes.select("id").join(graph.in_strength(conducting), "id", "left").select("id", F.coalesce("in_strength", F.lit(0.0)).alias("potential"))
    classes = seeding.weight_classes(strength)
    asked = queries.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("id"), "v")
    named = nodes.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "v")
    kinds = dict(nodes.dtypes)["id"], dict(queries.dtypes)["query_id"]
    bare = lambda c, kind: F.substring(c, 2, 2**31 - 1).cast(kind)
    near = ranking.nearest(named, asked, max(candidates, k)).select(bare("query_id", kinds[1]).alias("query_id"), bare("id", kinds[0]).alias("id"), "cosine", "rank")
    near = cut(near.join(nodes.select("id", "v"), "id"))
    if conducting.isEmpty():
        return _nearest_only(nodes, edges, queries, near.where(F.col("rank") <= k))
    near = near.where(F.col("rank") <= candidates)
    seeds = cut(seeding.diversified(near.join(classes.select("id", "weight_class"), "id"), k_seeds, lam, candidates).select("query_id", "id", F.col("weight").alias("x")))
    # sums come in any order, so activation is rounded before nodes are ranked by it
    active = graph.spread(conducting, seeds, operator).withColumn("x", F.round("x", 12))
    chosen = cut(assemble.strongest(active, nodes, k))
    kept = assemble.result_edges(edges, chosen, seeds, F.lit(1))
    return {"seeds": seeds, "nodes": chosen, "edges": kept, "verdicts": assemble.verdicts(chosen, kept, queries)}


def _nearest_only(nodes: DataFrame, edges: DataFrame, queries: DataFrame, near: DataFrame) -> dict[str, DataFrame]:
    """The result of a graph without edges: the nearest nodes as they are, anchors among them, each as active as
    its cosine, at least 0; the verdict names the lack of edges."""
    told = near.join(nodes.select("id", "is_anchor"), "id")
    chosen = cut(told.select("query_id", "id", F.greatest("cosine", F.lit(0.0)).alias("x"), "rank", "is_anchor"))
    none = assemble.result_edges(edges, chosen.limit(0), chosen.select("query_id", "id").limit(0), F.lit(1))
    verdicts = assemble.verdicts(chosen, none, queries)
    verdicts = verdicts.withColumn("gaps", F.concat_ws("; ", F.lit("no edges in the graph: nearest nodes only, nothing spread"), F.nullif("gaps", F.lit(""))))
    return {"seeds": chosen.select("query_id", "id", "x").limit(0), "nodes": chosen, "edges": none, "verdicts": verdicts}
