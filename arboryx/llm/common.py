"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import graph

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def integer_ids(docs: DataFrame, id_col: str) -> None:
    """Raises a TypeError unless the ids are whole numbers."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; ids must be whole numbers here")


def tiled(df: DataFrame, keys: Sequence[str], id_col: str, cap: int) -> DataFrame:
    """Split groups that hold more than ``cap`` rows into pairs of blocks.

    Adds ``tile_a <= tile_b`` and ``block``: a group of k blocks becomes the k(k+1)/2 tiles of two
    blocks (or of one with itself), so that every two rows of the group meet in exactly one tile
    as far as their blocks differ, and no tile holds more than about 2 * cap rows.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    blocks = F.coalesce(F.ceil(F.col("_n") / F.lit(cap)), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64(id_col, F.lit("tile")), F.col("_k")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("_k") - 1),
        lambda i: F.struct(F.least(i, F.col("block")).alias("a"), F.greatest(i, F.col("block")).alias("b")),
    )
    return (
        df.join(sizes, list(keys), "left")
        .withColumn("_k", blocks)
        .withColumn("block", block)
        .withColumn("_t", F.explode(tiles))
        .withColumns({"tile_a": F.col("_t.a"), "tile_b": F.col("_t.b")})
        .drop("_n", "_k", "_t")
    )


def joining_forest(near: Callable[[int, np.ndarray], np.ndarray], group: np.ndarray):
    """Edges (i, j) that connect the groups of points as links connect them, one edge for each group that is reached.

    ``near`` tells which of some points link with a point. Breadth first, each point against the points of groups not yet
    reached; no edge is within a group. Where each point is its own group, this is a spanning forest.
    """
    left, right, rest = [], [], np.arange(len(group))
    while len(rest):
        own = group[rest] == group[rest[0]]
        frontier, rest = rest[own].tolist(), rest[~own]
        while frontier and len(rest):
            p = frontier.pop()
            found = rest[near(p, rest)]
            if len(found):
                names, at = np.unique(group[found], return_index=True)
                left += [p] * len(names)
                right += found[at].tolist()
                reached = np.isin(group[rest], names)
                frontier += rest[reached].tolist()
                rest = rest[~reached]
    return left, right


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node reachable; nodes without an edge to another are left out."""
    return graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "node")


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
