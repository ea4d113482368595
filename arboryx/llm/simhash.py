"""SimHash near-duplicates: pigeonhole blocks find the pairs, a Hamming distance verifies them; wide fingerprints for smaller similarities."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..lineage import cut, small as small_side
from .common import components, joining_forest, tiled

BITS = 64
#: Buckets up to this size are joined with themselves; larger ones are searched for a spanning forest.
SMALL_BUCKET = 32
#: Most rows of a block of a large bucket; a task holds two blocks at a time.
BLOCK_ROWS = 4096
#: Bits of a wide fingerprint, for similarities at which 64 bits tell too little, and the columns of its words.
WIDE = 512
WORDS = [f"w{i}" for i in range(WIDE // BITS)]
#: Words that the distance is taken from; blocks are cut from all.
COMPARED = WORDS[:4]
#: Wide fingerprints link at so many differing bits of COMPARED: sets of a Jaccard similarity of 0.8 differ in 39 +- 6
#: (four elements against five, the worst case since four often tie: 48 +- 6), unlike ones in 128 +- 8.
WIDE_DISTANCE = 72
#: So many blocks of wide fingerprints are searched first; the others only for what connects the groups found there.
FIRST_BLOCKS = 8


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text: signed, so that it fits a long."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 65536):
        some = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist())]
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) for every row; A-Z are lower-cased, repeated shingles count."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of which two fingerprints at most ``distance`` apart agree on at least one.

    64 bits are cut into b > distance blocks; b - distance of them agree. b grows with the number
    of rows, so that a key has about two bits more than rows need and chance meetings stay few.
    """
    need = math.log2(max(n, 2)) + 2
    b = next((b for b in range(distance + 1, 13) if BITS * (b - distance) / b >= need), 12)
    edges = [round(i * BITS / b) for i in range(b + 1)]
    blocks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(kept) for kept in combinations(blocks, b - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def spanning_forest(fp: np.ndarray, distance: int):
    """Edges (i, j) that connect whatever links of at most ``distance`` connect.

    Breadth first, each point against the points not yet reached.
    """
    left, right, rest = [], [], np.arange(len(fp))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            p = frontier.pop()
            near = np.bitwise_count(fp[rest] ^ fp[p]) <= distance
            if near.any():
                found = rest[near]
                left += [p] * len(found)
                right += found.tolist()
                frontier += found.tolist()
                rest = rest[~near]
    return left, right


def near_links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) between the fingerprints of ``classes`` (fp distinct) that connect what links connect.

    A link is a Hamming distance of at most ``distance``. Buckets of up to SMALL_BUCKET rows give
    all their links by a join; of larger buckets a spanning forest is enough, found tile by tile.
    """
    masks = block_masks(classes.count(), distance)
    keys = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for j, m in enumerate(masks)])
    keyed = classes.select("fp", F.explode(keys).alias("k")).select("k.j", "k.v", "fp")
    shared = keyed.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, ["j", "v"]))
    small = met.where(F.col("n") <= SMALL_BUCKET)
    pairs = (
        small.alias("x")
        .join(small.alias("y"), ["j", "v"])
        .where(F.col("x.fp") < F.col("y.fp"))
        .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp")
        fp = pdf["fp"].to_numpy()
        i, j = spanning_forest(fp.view(np.uint64), distance)
        return pd.DataFrame({"a": fp[i], "b": fp[j]})

    large = met.where(F.col("n") > SMALL_BUCKET).drop("n")
    forests = (
        tiled(large, ["j", "v"], "fp", BLOCK_ROWS)
        .groupBy("j", "v", "tile_a", "tile_b")
        .applyInPandas(forest, "a long, b long")
    )
    return pairs.union(forests).distinct()


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WIDE bits of a set of 64-bit hashes, as words: a bit is set where more than half of the set vote for it."""
    seeds = np.random.default_rng(10).integers(0, 1 << 64, len(WORDS), np.uint64)
    votes = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit into a byte
        x = hashes[at : at + 255, None] + seeds
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)


def wide_blocks(n: int) -> np.ndarray:
    """Bits of a wide fingerprint by block: (blocks, bits of a block), for ``n`` fingerprints.

    The bits are shuffled some times and cut into blocks each time. A block is so wide that 64 to 128 fingerprints agree on
    it by chance (fewer, where there are fewer than 2^14), and blocks are so many that of a thousand pairs whose bits differ
    with a probability of 0.1875 (four elements against five) about one agrees on none, were bits not drawn repeatedly.
    """
    width = max(8, math.ceil(math.log2(max(n, 2))) - 7)
    each = WIDE // width
    rounds = math.ceil(math.log(1000) / 0.8125**width / each)
    rng = np.random.default_rng(11)
    return np.concatenate([rng.permutation(WIDE)[: each * width].reshape(each, width) for _ in range(rounds)])


def block_keys(fps: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(fingerprints, blocks): the bits of each block as a number, with the block's number above them."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    keys = np.empty((len(fps), len(blocks)), np.int64)
    for j, block in enumerate(blocks):
        keys[:, j] = bits[:, block] @ (1 << np.arange(len(block), dtype=np.int64)) + (j << 40)
    return keys


def bucket_forest(fp: np.ndarray, distance: int, group: np.ndarray):
    """``joining_forest`` of a bucket's wide fingerprints; in one of few rows those without a link out of their group are set aside first."""
    some = np.arange(len(fp))
    if len(fp) <= 512:
        apart = np.zeros((len(fp), len(fp)), np.uint16)
        for word in fp.T:
            apart += np.bitwise_count(word[:, None] ^ word)
        some = np.flatnonzero(((apart <= distance) & (group[:, None] != group)).any(axis=1))
    fp = fp[some]
    i, j = joining_forest(lambda p, rest: np.bitwise_count(fp[rest] ^ fp[p]).sum(axis=1, dtype=np.int64) <= distance, group[some])
    return some[i].tolist(), some[j].tolist()


def wide_links(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the rows of ``classes`` (rep long, a column for each of WORDS) whose wide fingerprints link.

    Rows that agree on a block (``wide_blocks``) meet, and a distance of at most WIDE_DISTANCE links them. A bucket of the
    first blocks gives a spanning forest, of more than BLOCK_ROWS rows one for each part of that size. All that is left, the
    other blocks and tiles of two parts, gives one edge for two groups found by then, so that the edges of a large group are
    some times its rows, whatever the number of blocks and tiles that its rows meet in.
    """
    n = classes.count()
    blocks, distance = wide_blocks(n), WIDE_DISTANCE

    def keys(batches):
        for batch in batches:
            fps = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            found = block_keys(fps, blocks)
            ends = np.arange(len(found) + 1, dtype=np.int32) * len(blocks)
            columns = [batch.column(c) for c in ("rep", *COMPARED)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, found.ravel())], names=["rep", *COMPARED, "keys"])

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["rep"], pdf["key"]))]
        fp, rep, key, group = pdf[COMPARED].to_numpy().view(np.uint64), *(pdf[c].to_numpy() for c in ("rep", "key", "group"))
        group = np.where(group < 0, rep, group)
        ends = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        a, b = [], []
        for start, end in zip(ends, ends[1:]):
            if (group[start:end] != group[start]).any():
                i, j = bucket_forest(fp[start:end], distance, group[start:end])
                a += [start + x for x in i]
                b += [start + x for x in j]
        found = pd.DataFrame({"a": rep[a], "b": rep[b], "low": np.minimum(group[a], group[b]), "high": np.maximum(group[a], group[b])})
        return found.drop_duplicates(["low", "high"])

    def keyed(df, at, some):
        return df.select(F.explode(F.slice("keys", at, some)).alias("key"), "rep", *COMPARED, "group")

    def hot_keys(rows):
        return cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS).select("key"))

    def of_several_groups(rows, hot):
        own = F.when(F.col("group") < 0, F.col("rep")).otherwise(F.col("group"))
        return cut(rows.join(small_side(hot), "key", "left_semi").groupBy("key").agg((F.min(own) < F.max(own)).alias("several")).where("several").select("key"))

    def few(rows, hot):
        dealt = F.pmod(F.xxhash64("key"), F.lit(max(1, n * len(blocks) // BLOCK_ROWS)))
        return rows.join(small_side(hot), "key", "left_anti").withColumns({"g": dealt, "tile_a": F.lit(-1), "tile_b": F.lit(-1)})

    def many(rows, hot, which):
        return tiled(rows.join(small_side(hot), "key", "left_semi"), ["key"], "rep", BLOCK_ROWS).withColumn("g", F.xxhash64("key")).where(which)

    def edges(met):
        columns = ["key", "rep", *COMPARED, "group", "g", "tile_a", "tile_b"]
        met = reduce(DataFrame.union, [m.select(columns) for m in met])
        found = met.groupBy("g", "tile_a", "tile_b").applyInPandas(forest, "a long, b long, low long, high long")
        return cut(found.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("e")).select("e.a", "e.b"))

    blocked = cut(classes.select("rep", *WORDS).mapInArrow(keys, ", ".join(f"{c} long" for c in ["rep", *COMPARED]) + ", keys array<long>"))
    rows = keyed(blocked.withColumn("group", F.lit(-1).cast("long")), 1, FIRST_BLOCKS)
    hot = hot_keys(rows)
    is_hot = not hot.isEmpty()
    first = edges([few(rows, hot), *([many(rows, hot, "tile_a = tile_b")] if is_hot else [])])
    named = components(first).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    grouped = cut(blocked.join(named, "rep", "left").withColumn("group", F.coalesce("group", F.lit(-1))))
    met = []
    if is_hot:
        rows = keyed(grouped, 1, FIRST_BLOCKS)
        met.append(many(rows, of_several_groups(rows, hot), "tile_a < tile_b"))
    rows = keyed(grouped, FIRST_BLOCKS + 1, len(blocks))
    hot = hot_keys(rows)
    met.append(few(rows, hot))
    if not hot.isEmpty():
        met.append(many(rows, of_several_groups(rows, hot), "tile_a <= tile_b"))
    return first.union(edges(met))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """Components of near-copies by SimHash.

    Returns (id, fp long, component_id): component_id is the smallest id reachable over links of
    at most ``distance`` differing bits. Null and empty texts have fingerprint zero and link like
    any other; repeated rows stay repeated; extra columns of ``docs`` are not looked at. Rows without
    an id link like any other but name no component: one of only such rows is null. A very long text
    is hashed whole; an empty table gives no row. Each fingerprint has as many keys as
    ``block_masks`` has masks: 5 for few rows, 70 for 10^9.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    comp = components(near_links(classes, distance))
    rooted = cut(classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")
