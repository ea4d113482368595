"""A consolidation pass: absorbed nodes, their edges and their pending deltas move to the anchors in one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboryx.lineage import cut
from arboryx.sources.versions import VersionSet

from . import evolve, identity


def followed(remap: DataFrame) -> DataFrame:
    """(member, anchor) with chains followed to their end; members that only lead round in a circle are left out.

    Pointers are doubled, so a chain of n steps takes log2(n) rounds. A circle has no end: after
    enough rounds for the longest chain, what still points to a member is in one or leads into one.
    """
    now = cut(remap.select("member", "anchor"))
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("member").alias("anchor"), F.col("anchor").alias("beyond"))
        moved = cut(now.join(ahead, "anchor", "left").select("member", F.coalesce("beyond", "anchor").alias("anchor"), F.col("beyond").isNotNull().alias("moved")))
        now = moved.select("member", "anchor")
        if moved.where("moved").isEmpty():
            return now
    return now.join(now.select(F.col("member").alias("anchor")), "anchor", "left_anti").select("member", "anchor")


def fused(nodes: DataFrame, remap: DataFrame, most_tags: int = 32) -> DataFrame:
    """``nodes`` (id, description, born, last_fired, fired_total, tags, candidate) with members folded into their anchors.

    The anchor keeps its description; counters add up, times take the outer bounds, tags follow the anchor's in
    the order of the members' ids, each once, ``most_tags`` of an absorbing node. Who absorbed another is no candidate any more. Members whose
    anchor is no node stay as they are.
    """
    known = remap.join(nodes.select(F.col("id").alias("anchor")), "anchor", "left_semi")
    moving = nodes.join(known.select(F.col("member").alias("id"), "anchor"), "id").groupBy(F.col("anchor").alias("id")).agg(
        F.min("born").alias("_born"), F.max("last_fired").alias("_last"), F.sum("fired_total").alias("_fired"),
        F.array_sort(F.collect_list(F.struct("id", "tags"))).alias("_tags"),
    )
    stay = nodes.join(known.select(F.col("member").alias("id")), "id", "left_anti").join(moving, "id", "left")
    more = F.flatten(F.transform("_tags", lambda m: m["tags"]))
    absorbed = F.col("_fired").isNotNull()
    return stay.select(
        "id", "description", F.least("born", "_born").alias("born"), F.greatest("last_fired", "_last").alias("last_fired"),
        (F.col("fired_total") + F.coalesce("_fired", F.lit(0))).alias("fired_total"),
        F.when(absorbed, F.slice(F.array_distinct(F.concat("tags", more)), 1, most_tags)).otherwise(F.col("tags")).alias("tags"), (F.col("candidate") & ~absorbed).alias("candidate"),
    )


def _moved(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """``rows`` (src, dst, ...) with both ends at the anchors, without the loops that the move made."""
    to = remap.select("member", "anchor")
    out = rows.join(to.select(F.col("member").alias("src"), F.col("anchor").alias("_s")), "src", "left").join(to.select(F.col("member").alias("dst"), F.col("anchor").alias("_d")), "dst", "left")
    out = out.withColumns({"_from": F.coalesce("_s", "src"), "_to": F.coalesce("_d", "dst")}).where("_from <> _to or src = dst")
    return out.withColumns({"src": F.col("_from"), "dst": F.col("_to")}).select(*rows.columns)


def rewired(edges: DataFrame, remap: DataFrame, most: float = 1.0) -> DataFrame:
    """``edges`` (src, dst, rel, weight, born, last_fired) at the anchors; equal keys add up, held at ``most``, and take the outer times.

    Edges that no member touches are not added up, so parallel ones stay.
    """
    ends = remap.select(F.col("member").alias("id")).unionByName(remap.select(F.col("anchor").alias("id"))).distinct()
    touched = edges.join(ends.select(F.col("id").alias("src"), F.lit(True).alias("_a")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    touched = cut(touched.withColumn("_t", F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b"))
    sums = _moved(touched.where("_t").drop("_t"), remap).groupBy("src", "dst", "rel").agg(F.least(F.lit(most), F.sum("weight")).alias("weight"), F.min("born").alias("born"), F.max("last_fired").alias("last_fired"))
    return touched.where("not _t").select("src", "dst", "rel", "weight", "born", "last_fired").unionByName(sums)


def consolidate(store: VersionSet, verdicts: DataFrame, most_out: int = 10_000, most: float = 1.0) -> int:
    """One pass over the latest version of ``store`` (tables nodes, edges, deltas); returns the version it wrote.

    ``verdicts`` is (member, anchor, verdict): what is "same" merges, save members that several anchors claim. All
    three tables and ``absorbed`` (member, anchor) are committed together, so a pass that fails on the way
    leaves the version before, and no delta ever names a node that is gone. Without any merge the tables are
    written as they are.
    """
    nodes, edges, deltas = (store.read(t) for t in ("nodes", "edges", "deltas"))
    wanted = identity.resolve(verdicts).join(nodes.select(F.col("id").alias("member")), "member", "left_semi").join(nodes.select(F.col("id").alias("anchor")), "anchor", "left_semi")
    remap = cut(followed(wanted.where("member <> anchor")))
    kept = evolve.saturated(rewired(edges, remap, most), most_out, most)
    return store.commit({"nodes": fused(nodes, remap), "edges": kept, "deltas": _moved(deltas, remap), "absorbed": remap})
