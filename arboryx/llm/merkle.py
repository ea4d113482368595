"""Merkle manifest of a dataset: a tree per source, a tree over the sources' roots, and a proof for every row.

Rows of a source are numbered and cut into aligned blocks of 3^6. A block keeps each of its levels as one
string, the hexadecimal digests one after the other; parents are hashes of its substrings of fixed
width, siblings the substrings beside. The blocks' own roots are the leaves of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut

ARITY, DEPTH, HEX = 3, 6, 64
SPAN, RUN = ARITY**DEPTH, ARITY * HEX


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hex SHA-256 of fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    as_text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in as_text]), 256)


def _hash(data: Column) -> Column:
    return F.sha2(data, 256).cast("binary")  # digests as text, in bytes: substrings of bytes need no search


def _positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (g first) with ``pos``, from 0 inside each g by ``order``.

    A range sort deals a large g over many tasks; the driver gets one row per task, of the groups at its
    ends, from which it knows how much of a task's first group lies before it.
    """
    kept = cut(rows.orderBy(*order))

    def ends(batches):
        first = last = None
        n_last = n = 0
        for batch in batches:
            g = batch.column(0)
            starts = _starts(g)
            for at, stop in zip(starts, [*starts[1:], len(g)]):
                name = g[int(at)].as_py()
                if first is None:
                    first = name
                if name == last:
                    n_last += int(stop - at)
                else:
                    last, n_last = name, int(stop - at)
                n += int(stop - at)
        if n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "first": first, "last": last, "n_last": n_last, "n": n}])

    carried, group, count = {}, None, 0
    for part, first, last, n_last, n in sorted(tuple(r) for r in kept.select("g").mapInArrow(ends, "part long, first string, last string, n_last long, n long").collect()):
        carried[part] = (first, count if first == group else 0)
        group, count = last, n_last + (carried[part][1] if first == last else 0)

    def number(batches):
        before, held = carried.get(TaskContext.get().partitionId(), (None, 0))
        for batch in batches:
            g = batch.column(0)
            if not len(g):
                continue
            starts = _starts(g)
            pos = np.arange(len(g)) - np.repeat(starts, np.diff([*starts, len(g)]))
            if g[0].as_py() == before:
                pos[: starts[1] if len(starts) > 1 else len(g)] += held
            before, held = g[len(g) - 1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], names=[*batch.schema.names, "pos"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(number, f"{fields}, pos long")


def _starts(g: pa.Array) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.concatenate([[0], np.flatnonzero(np.asarray(pc.not_equal(g[1:], g[:-1]))) + 1]).astype(np.int64) if len(g) else np.empty(0, np.int64)


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(g, block, nodes, levels) of (g, pos, digest, item): ``levels`` are strings of digests, the last of one digest.

    The first block of a group, if it is not full, is all of it and ends where one node is left. Any other
    block lies beside others, so all six levels are there, though the last ones may be of one node each.
    """
    grouped = nodes.groupBy("g", F.floor(F.col("pos") / SPAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "item"))).alias("nodes"))
    needed = F.when((F.col("block") > 0) | (F.size("nodes") == SPAN), DEPTH)
    for depth in range(DEPTH + 1):
        needed = needed.when(F.size("nodes") <= ARITY**depth, depth)
    lowest = F.array_join(F.transform("nodes", lambda x: x["digest"]), "").cast("binary")
    steps = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array("lowest"), lambda made, _: F.concat(made, F.array(_parents(F.element_at(made, -1)))))
    return cut(grouped.withColumns({"depth": needed, "lowest": lowest}).select("g", "block", "nodes", levels.alias("levels")))


def _path(levels: Column, place: Column) -> Column:
    """The siblings to the left and to the right of a block's node at ``place``, level by level."""

    def siblings(level: Column, depth: Column) -> Column:
        node = F.floor(place / F.pow(F.lit(float(ARITY)), depth)).cast("int")
        start = F.floor(node / ARITY).cast("int") * RUN
        own = (node % ARITY) * HEX
        left = F.substring(level, start + 1, own)
        right = F.substring(level, start + own + HEX + 1, F.lit(RUN - HEX) - own)
        return F.struct(left.alias("left"), right.alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), siblings)


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of all rounds, and (g, digest) of the roots; a round has 729 times fewer nodes than the one before."""
    rounds = []
    while True:
        blocks = _blocks(nodes)
        rounds.append(blocks)
        tops = blocks.select("g", F.col("block").alias("pos"), F.element_at("levels", -1).cast("string").alias("digest"), F.lit(None).cast("string").alias("item"))
        if not (blocks.agg(F.max("block")).first()[0] or 0):
            return rounds, tops.select("g", "digest")
        nodes = tops


def _paths(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(g, item, digest, path, root, subroot) of the lowest nodes; ``roots`` has (g, path, root, subroot) above each group.

    Each round joins blocks with what is above them, one row for one row, so no group is gathered or multiplied.
    """
    above = roots.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        of = above.select("g", F.col("pos").alias("block"), F.col("path").alias("higher"), "root", "subroot")
        each = F.transform("nodes", lambda x, i: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["item"].alias("item"), F.concat(_path(F.col("levels"), i), F.col("higher")).alias("path")))
        above = blocks.join(of, ["g", "block"]).select("g", "root", "subroot", F.inline(each))
    return above


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, seen: Column) -> DataFrame:
    """(id, leaf, seen, subroot, root, path): the tree over ``rows`` and each row's siblings from its leaf to the root.

    ``leaf`` is the hash of a row as it was, ``seen`` that of what is to be verified. Leaves of a group lie
    in the order of their ids (nulls first; equal ids by leaf), groups in the order of their names' bytes
    (null first). ``path`` has an element per level, lowest first: the digests to the left and to the
    right of the node, in hexadecimal text as bytes, both empty where the node has no siblings; it is empty for a single row.
    """
    kind = dict(rows.dtypes)[id_col]
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit(""))
    leaves = rows.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), seen.alias("seen"))
    numbered = _positions(leaves, ["g", "id", "digest", "seen"])
    low, subroots = _rounds(numbered.select("g", "pos", "digest", F.struct("id", "seen").alias("item")))
    # the sources' own tree: they are numbered as one group, whose items are their names
    named = _positions(subroots.select(F.lit("").alias("g"), F.col("g").alias("item"), "digest"), ["g", "item"])
    high, root = _rounds(named.select("g", "pos", "digest", "item"))
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    top = root.select("g", nothing.alias("path"), F.col("digest").alias("root"), F.lit(None).cast("string").alias("subroot"))
    sources = _paths(high, top).select(F.col("item").alias("g"), "path", "root", F.col("digest").alias("subroot"))
    found = _paths(low, sources)
    return found.select(F.col("item.id").cast(kind).alias("id"), F.col("digest").alias("leaf"), F.col("item.seen").alias("seen"), "subroot", "root", "path")


def siblings_text(path: Column) -> Column:
    """All siblings of a path in one string, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"]).cast("string")), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf.cast("binary"), lambda node, s: _hash(F.concat(s["left"], node, s["right"]))).cast("string")


def verify(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    Leaves hash ``fields``; ``changed`` are fields as they are found later, whose leaves are folded with the
    original siblings. Null fields are ``-``, empty ones ``0:``; repeated rows are leaves of their own, with equal
    hashes but siblings by their places; rows without an id come first in their source; an empty table
    gives no row; other columns are not looked at.
    """
    now = [(changed or {}).get(f, F.col(f"`{f}`")) for f in fields]
    tree = manifest(docs, id_col, group_col, leaf_hash([F.col(f"`{f}`") for f in fields]), leaf_hash(now))
    out = tree.select("id", "leaf", "subroot", "root", F.sha2(siblings_text(F.col("path")), 256).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)
