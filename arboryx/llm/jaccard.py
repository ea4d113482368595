"""Near-copies by the Jaccard similarity of word shingles: SimHash finds candidates, whole sets verify them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from ..lineage import cut, small as small_side
from . import simhash
from .common import components, joining_forest, tiled
from .substring import variant_of

#: Most rows of a block of a large candidate group, and about the rows of a task for small ones.
BLOCK_ROWS = 512


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = (xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist()))
    return np.unique(np.fromiter(hashes, np.uint64, len(starts)))


def spanning_forest(sets: list[np.ndarray], least: float, group: np.ndarray):
    """``joining_forest`` of groups of sets, linked by similarities of at least ``least``; no set is empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)

    def near(p, rest):
        own = codes[starts[p] : starts[p] + sizes[p]]
        mark[own] = True
        common = np.add.reduceat(mark[codes], starts, dtype=np.int64)[rest]
        mark[own] = False
        return common >= least * (sizes[p] + sizes[rest] - common) - 1e-9

    return joining_forest(near, group)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """Components of near-copies: (id, variant, component_id, kept).

    A link is a Jaccard similarity of at least ``least`` between the sets of ``width``-word shingles;
    A-Z are lower-cased. Texts whose wide SimHash fingerprints agree on a block and lie near each other
    are candidates (``simhash.wide_links``, which suits 0.8 or more), and every two texts of a connected group of candidates
    are compared by their whole sets, in one task or, where they are more than BLOCK_ROWS, in blocks and then in tiles of two
    blocks. A task gives only a spanning forest, and a tile only what connects the groups that blocks have found. Equal sets
    are one entry; null and empty texts are copies of each other.

    ``variant``, a hash of the text, tells rows of one id apart, so that a text links only for itself.
    ``component_id`` is the smallest id reachable over links; ``kept`` are the rows of one text of each
    component, that of the smallest (id, variant). Repeated rows are one row here each. Rows without an
    id are left out; an empty table gives no row; extra columns are not looked at.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), variant_of(text_col).alias("variant"), F.col(text_col).alias("text"))

    def sign(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column(2)]
            fps = np.array([simhash.wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, len(simhash.WORDS)).view(np.int64)
            copies = [xxh3_128_digest(s.tobytes()) for s in sets]
            columns = [batch.column(0), batch.column(1), pa.array(copies, pa.binary()), pa.array([len(s) > 0 for s in sets])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(w) for w in fps.T)], names=["id", "variant", "copy", "some", *simhash.WORDS])

    signed = cut(rows.mapInArrow(sign, f"id {kind}, variant long, copy binary, some boolean, {', '.join(f'{w} long' for w in simhash.WORDS)}"))
    words = [F.first(w).alias(w) for w in simhash.WORDS]
    classes = cut(signed.groupBy("copy").agg(F.min(F.struct("id", "variant")).alias("first"), F.first("some").alias("some"), *words))
    classes = classes.withColumn("rep", F.monotonically_increasing_id())  # holds, since a checkpoint is read
    met = components(simhash.wide_links(classes.where("some"))).withColumnRenamed("component", "c")
    met = cut(met.join(met.groupBy("c").agg(F.count("*").alias("n")), "c"))
    is_small = F.col("n") <= BLOCK_ROWS
    few = met.where(is_small).count()
    batches = math.ceil((few or 1) / BLOCK_ROWS)
    alone, columns = F.lit(-1), ["c", "node", "g", "tile_a", "tile_b", "group"]
    small = met.where(is_small).withColumns({"g": F.pmod(F.xxhash64("c"), F.lit(batches)), "tile_a": alone, "tile_b": alone})
    large = tiled(met.where(~is_small), ["c"], "node", BLOCK_ROWS).withColumn("g", F.xxhash64("c"))

    def whole(found):
        for batch in found:
            kept = [(i, s.tobytes()) for i, s in enumerate(shingles(t.as_py(), width) for t in batch.column("text")) if len(s)]
            rest = batch.drop_columns(["text"]).take(pa.array([i for i, _ in kept], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([s for _, s in kept], pa.binary())], names=[*rest.schema.names, "hashes"])

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("c"):
            node = part["node"].to_numpy()
            group = part["group"].to_numpy()
            i, j = spanning_forest([np.frombuffer(s, np.uint64) for s in part["hashes"]], least, group)
            a += group[i].tolist() if i else []
            b += group[j].tolist() if j else []
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    def links(tiles):
        named = cut(tiles.select(columns).join(classes.select(F.col("rep").alias("node"), "first.id", "first.variant"), "node"))
        full = rows.join(named, ["id", "variant"]).select(*columns, "text")
        full = full.mapInArrow(whole, "c long, node long, g long, tile_a int, tile_b int, group long, hashes binary")
        return cut(full.groupBy("g", "tile_a", "tile_b").applyInPandas(forest, "a long, b long"))

    own = small.drop("n").unionByName(large.where("tile_a = tile_b").drop("n", "block"))
    comp = components(links(own.withColumn("group", F.col("node"))))
    if met.count() > few:
        comp, tile = cut(comp), ["g", "c", "tile_a", "tile_b"]
        across = large.where("tile_a < tile_b").join(comp, "node", "left").withColumn("group", F.coalesce("component", "node"))
        across = cut(across.select(columns))
        apart = cut(across.groupBy(tile).agg((F.min("group") < F.max("group")).alias("several")).where("several").select(tile))
        joined = components(links(across.join(small_side(apart), tile, "left_semi")))  # of groups, by their smallest nodes
        top = joined.select(F.col("node").alias("component"), F.col("component").alias("top"))
        comp = comp.union(joined.select("node", "node")).distinct().join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    rooted = cut(classes.join(comp, classes.rep == comp.node, "left").select("copy", "first", F.coalesce("component", "rep").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("of")), "root").select("copy", "of")
    kept = (F.col("id") == F.col("of.id")) & (F.col("variant") == F.col("of.variant"))
    return signed.join(named, "copy").select(F.col("id").alias(id_col), "variant", F.col("of.id").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps, and those without an id.

    Of kept rows that share id and text one stays, whichever it is. Only what is dropped or repeated
    is joined with ``docs``.
    """
    found = cut(near_duplicates(docs, id_col, text_col, width, least).select(F.col(id_col).alias("id"), "variant", "kept"))
    seen = found.where("kept").groupBy("id", "variant").agg(F.count("*").alias("n")).where("n > 1").select("id", "variant")
    again = cut(seen)
    gone = found.where("not kept").select("id", "variant").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), variant_of(text_col).alias("variant"))
    alone = rows.join(gone.union(again), ["id", "variant"], "left_anti")
    one = rows.join(again, ["id", "variant"]).dropDuplicates(["id", "variant"])
    return alone.unionByName(one).select("row.*")
