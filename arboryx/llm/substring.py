"""Substring dedup: a De Bruijn graph of token k-mers, compacted into repeated spans.

Every run of ``k`` consecutive words is an edge of the graph. Consecutive edges of a document that
share their minimizer (the m-word piece with the smallest hash) travel together as one path, to the
bucket of that minimizer, so that all occurrences of an edge meet in one bucket while a word is
shipped about once. A bucket finds each edge's source, its smallest coordinate (document, start);
edges that start later are repeated. Repeated edges that follow each other both in the document and in
the source form a nonbranching path. Edges of a minimizer that too many different paths share travel one by one,
each to the bucket of its own hash, so that no bucket holds such a minimizer whole. Paths from different buckets are
compacted by a join of path ends with path starts on (document, position, source document, diagonal). A span is kept together
only as far as its source coordinates advance in step with it.

An edge is identified by its 64-bit minimizer and 48 more bits of its own hash, a source by its coordinates,
which have to go on in step. Words themselves are not compared again: hashes of edges start from 64-bit
hashes of words, so two different words are taken for one with a probability of 2^-64 a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut
from .common import integer_ids

#: Words of a minimizer.
MINIMIZER = 5
#: Text bytes that a task works on at a time (a longer document is worked on whole), and those whose edges share a bucket on average.
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
#: Edges from which on a minimizer's paths are taken apart, if they are also more than 1 / HOT_MINIMIZERS of all edges (so
#: no more minimizers than that are hot), and of how many different paths one is counted to find them.
HOT_EDGES, HOT_MINIMIZERS = 500_000, 1_000_000
COUNTED = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(1).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """Powers of a number modulo 2**64, as many as have been asked for."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            factors = np.full(n + (n >> 3), self.base)
            factors[0] = 1
            self.known = np.multiply.accumulate(factors)
        return self.known[:n]


def hashed_words(texts: list[bytes], powers: tuple[_Powers, _Powers]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of the text that each word is in."""
    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[blob]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    up, down = powers
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[blob] * down.upto(len(blob)))])
    words = _mixed((total[ends] - total[starts]) * up.upto(len(blob))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return words, np.searchsorted(bounds, starts, "right")


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(k):
        h = h * np.uint64(_BASE) + words[i : n + i]
    return _mixed(h)


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value in each run of ``width`` values."""
    val, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left = val[:-step] <= val[step:]
        val, at = np.where(left, val[:-step], val[step:]), np.where(left, at[:-step], at[step:])
        have += step
    return at


def paths(words: np.ndarray, doc: np.ndarray, k: int):
    """Paths of edges with one minimizer: (first word, edges, minimizer) and the hashes of all edges in turn."""
    n = len(words) - k + 1
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(inside):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    edge, piece = _rolled(words, k), _rolled(words, MINIMIZER)
    at = _leftmost_minimum(piece, k - MINIMIZER + 1)[inside]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)])
    first = np.flatnonzero(new)
    return inside[first], np.diff(np.append(first, len(inside))), piece[at[first]], edge[inside]


def _runs(doc, start, n, src_doc, src_start):
    """Joins neighbouring runs (in order) that continue each other in the document and in the source."""
    if not len(start):
        return doc, start, n, src_doc, src_start
    goes_on = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + n[:-1]) & (src_doc[1:] == src_doc[:-1])
    goes_on &= src_start[1:] - start[1:] == src_start[:-1] - start[:-1]
    head = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return doc[head], start[head], np.add.reduceat(n, head), src_doc[head], src_start[head]


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Bytes of an array, all first bytes, then all second ones and so on: high bytes of small numbers compress away."""
    return x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_COLUMNS = ["bucket", "ids", "variants", "doc", "start", "edges", "minimizer", "edge", "repeats"]


def _counted(texts: list[bytes], k: int, every: int, powers) -> tuple[np.ndarray, np.ndarray]:
    """(minimizer, edges) of one of ``every`` of the chunk's different paths, chosen by the hash of their first edge."""
    _, n, minimizer, edge = paths(*hashed_words(texts, powers), k)
    begin = edge[np.cumsum(n) - n]
    at = np.unique(begin, return_index=True)[1]
    at = at[_mixed(begin[at]) % np.uint64(every) == 0]
    return minimizer[at], n[at]


def _ship(ids: np.ndarray, variants: np.ndarray, texts: list[bytes], k: int, buckets: int, hot: np.ndarray, powers):
    """Rows for the buckets from one chunk of documents, ordered by id."""
    words, doc = hashed_words(texts, powers)
    first, n, minimizer, edge = paths(words, doc, k)
    if not len(first):
        return
    begin = np.searchsorted(doc, np.arange(len(texts)))
    d, start = doc[first], first - begin[doc[first]]
    offset = np.concatenate([[0], np.cumsum(n)])
    # equal paths of the chunk: only the first is shipped, later ones are repeated for certain
    by = np.lexsort([start, d, n, edge[offset[1:] - 1], edge[offset[:-1]]])
    same = (edge[offset[:-1]][by][1:] == edge[offset[:-1]][by][:-1]) & (edge[offset[1:] - 1][by][1:] == edge[offset[1:] - 1][by][:-1]) & (n[by][1:] == n[by][:-1])
    same &= minimizer[by][1:] == minimizer[by][:-1]
    group = np.cumsum(np.concatenate([[True], ~same])) - 1
    source = np.empty(len(first), np.int64)
    source[by] = by[np.flatnonzero(np.concatenate([[True], ~same]))][group]
    later = (ids[d] != ids[d[source]]) | (start != start[source])
    at = np.flatnonzero(later)
    repeats = _runs(d[at], start[at], n[at], d[source[at]], start[source[at]])
    repeats = np.stack([repeats[0], repeats[1], repeats[2], repeats[3], repeats[4]], axis=1).astype("<u4")
    keep = np.flatnonzero(~later)
    # from here on a hot minimizer's path is as many paths as it has edges
    apart = np.isin(minimizer[keep].view(np.int64), hot)
    pieces = np.where(apart, n[keep], 1)
    apart, keep = np.repeat(apart, pieces), np.repeat(keep, pieces)
    step = np.arange(len(keep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    d, start, n, minimizer, offset = d[keep], start[keep] + step, np.where(apart, 1, n[keep]), minimizer[keep], offset[keep] + step
    to = (np.where(apart, _mixed(edge[offset] ^ minimizer), minimizer) % np.uint64(buckets)).astype(np.int64)
    keep = np.argsort(to, kind="stable")
    to = to[keep]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1, [len(to)]]) if len(to) else np.zeros(1, np.int64)
    groups = len(cuts) - 1
    if not groups:  # all is repeated, which needs a row all the same
        keep, cuts, to, groups = np.empty(0, np.int64), np.array([0, 0]), np.zeros(1, np.int64), 1
    octets = edge.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    for g in range(groups):
        some = keep[cuts[g] : cuts[g + 1]]
        mine = repeats[g::groups]
        used, small = np.unique(np.concatenate([d[some], mine[:, 0], mine[:, 3]]), return_inverse=True)
        mine = mine.copy()
        mine[:, 0], mine[:, 3] = small[len(some) : len(some) + len(mine)], small[len(some) + len(mine) :]
        sizes = n[some]
        inner = np.repeat(offset[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        steps = np.diff(ids[used], prepend=np.int64(0))  # ids are in order here, so most steps are small
        yield (
            int(to[cuts[g]]), _planes(steps, "<i8"), _planes(variants[used], "<u4"), _planes(small[: len(some)], "<u4"), _planes(start[some], "<u4"),
            sizes.astype("u1").tobytes(), minimizer[some].astype("<u8").tobytes(), octets[inner].tobytes(), _planes(mine.ravel(), "<u4"),
        )


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated runs of the edges of one bucket: (doc, variant, start, edges, source doc, source start)."""
    get = lambda c, kind: [np.frombuffer(x, kind) for x in pdf[c]]
    apart = lambda c, kind: [_numbers(x, kind) for x in pdf[c]]
    ids, variants = [np.cumsum(x) for x in apart("ids", "<i8")], [x.astype(np.int64) for x in apart("variants", "<u4")]
    docs, repeats = apart("doc", "<u4"), apart("repeats", "<u4")
    out = []
    for i, v, r in zip(ids, variants, repeats):
        if len(r):
            r = r.reshape(-1, 5).astype(np.int64)
            out.append((i[r[:, 0]], v[r[:, 0]], r[:, 1], r[:, 2], i[r[:, 3]], r[:, 4]))
    doc = np.concatenate([i[d] for i, d in zip(ids, docs)])
    if len(doc):
        variant = np.concatenate([v[d] for v, d in zip(variants, docs)])
        start, n, mini = (np.concatenate(x) for x in (apart("start", "<u4"), get("edges", "u1"), get("minimizer", "<u8")))
        start, n = start.astype(np.int64), n.astype(np.int64)
        octets = np.concatenate([x.reshape(-1, 6) for x in get("edge", "u1")])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        order = np.lexsort([start, variant, doc])  # paths, and so edges, in the order of coordinates
        d, v, at = doc[order], variant[order], start[order]
        order = order[np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]) | (at[1:] != at[:-1])])]  # repeated rows once
        doc, variant, start, mini = doc[order], variant[order], start[order], mini[order]
        sizes = n[order]
        which = np.repeat(np.arange(len(order)), sizes)
        step = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        octets = octets[np.repeat(begin[order], sizes) + step]
        name = np.zeros((len(which), 8), np.uint8)
        name[:, 2:] = octets
        name = name.view("<u8").ravel() | (mini[which] & np.uint64(0xFFFF))
        by = np.argsort(name, kind="stable")
        new = np.concatenate([[True], (name[by][1:] != name[by][:-1]) | (mini[which[by]][1:] != mini[which[by]][:-1])])
        source = np.empty(len(which), np.int64)
        source[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        pos = start[which] + step
        sd, sp = doc[which[source]], pos[source]
        at = np.flatnonzero((doc[which] != sd) | (pos != sp))
        w = which[at]
        row = _runs(w, pos[at], np.ones(len(at), np.int64), sd[at], sp[at])
        out.append((doc[row[0]], variant[row[0]], *row[1:]))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 6
    return pd.DataFrame(dict(zip(["doc", "variant", "start", "n", "src_doc", "src_start"], cols))).astype("int64")


def variant_of(text_col: str):
    """24 bits of a text's hash, which tell rows of one id apart; ids are seldom repeated, so few bits do."""
    return F.xxhash64(text_col).bitwiseAND(F.lit((1 << 24) - 1))


def _chunks(batches, size: int):
    """Rows (id, variant, text) of about ``size`` bytes at a time, in order of ids, equal ones once."""
    rows, held = {}, 0
    for batch in batches:
        for i, v, t in zip(*(batch.column(c) for c in range(3))):
            t = t.as_py().encode()
            if rows and held + len(t) > size:
                yield [rows[key] for key in sorted(rows)]
                rows, held = {}, 0
            key = i.as_py(), v.as_py()
            rows[key] = (*key, t)
            held += len(t)
    if rows:
        yield [rows[key] for key in sorted(rows)]


def hot_minimizers(compared: DataFrame, k: int) -> np.ndarray:
    """Minimizers of too many edges for one bucket, as signed numbers in order; at most ``HOT_MINIMIZERS``, however large the table.

    One of ``COUNTED`` different paths of every chunk of every document is counted, so it is an estimate. It
    only decides which way edges travel; the repeats found are the same whatever it says.
    """

    chunk_bytes, every = CHUNK_BYTES, COUNTED

    def count(batches):
        powers = _Powers(_BASE), _Powers(_INVERSE)
        for rows in _chunks(batches, chunk_bytes):
            minimizer, n = _counted([r[2] for r in rows], k, every, powers)
            yield pa.RecordBatch.from_arrays([pa.array(minimizer.view(np.int64)), pa.array(n.astype(np.int64))], names=["minimizer", "n"])

    counts = cut(compared.mapInArrow(count, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n")))
    least = max(HOT_EDGES / every, (counts.agg(F.sum("n")).first()[0] or 0) / HOT_MINIMIZERS)
    return np.sort(counts.where(F.col("n") >= least).select("minimizer").toPandas()["minimizer"].to_numpy(np.int64))


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Repeated edges as runs (doc, variant, start, n, src_doc, src_start), not yet compacted across buckets."""
    integer_ids(docs, id_col)
    text_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(text_bytes / BUCKET_BYTES))
    compared = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long"), variant_of(text_col), text_col)
    hot, chunk_bytes = hot_minimizers(compared, k), CHUNK_BYTES

    def edges(batches):
        powers = _Powers(_BASE), _Powers(_INVERSE)
        for rows in _chunks(batches, chunk_bytes):
            made = list(_ship(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows], k, buckets, hot, powers))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*made))], names=_COLUMNS)

    schema = "bucket int, " + ", ".join(f"{c} binary" for c in _COLUMNS[1:])
    shipped = compared.mapInArrow(edges, schema)
    return shipped.groupBy("bucket").applyInPandas(_resolve, "doc long, variant long, start long, n long, src_doc long, src_start long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """Maximal spans of repeated edges: (doc, variant, start, n_words, src_doc, src_start).

    ``n_words`` words of the document from word ``start`` (from 0) also stand at ``src_start`` of
    ``src_doc``, earlier: in a smaller id, or before in the same document. Every repeated edge is in
    one span, and its source is the first place of all where it stands (or, within one task's
    chunk, the first place there). Ids are whole numbers; others raise a TypeError. ``variant`` is a hash of the text, which tells rows of one id apart.
    """
    runs = repeated_runs(docs, id_col, text_col, k).withColumn("diagonal", F.col("src_start") - F.col("start"))
    key = ["doc", "variant", "src_doc", "diagonal"]
    # both sides are reduced on the very keys of the join, so neither is shuffled twice
    ends = runs.select(*key, (F.col("start") + F.col("n")).alias("start")).groupBy(*key, "start").agg(F.lit(True).alias("_before"))
    linked = runs.groupBy(*key, "start").agg(F.max("n").alias("n")).join(ends, [*key, "start"], "left")
    along = Window.partitionBy(*key).orderBy("start")
    numbered = linked.withColumn("_path", F.sum(F.when(F.col("_before").isNull(), 1).otherwise(0)).over(along))
    return (
        numbered.groupBy(*key, "_path")
        .agg(F.min("start").alias("start"), (F.sum("n") + (k - 1)).alias("n_words"))
        .select("doc", "variant", "start", "n_words", "src_doc", (F.col("start") + F.col("diagonal")).alias("src_start"))
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, carry: bool = False) -> DataFrame:
    """Removes each word that a repeated edge covers: (id, n_words, n_removed, kept).

    Ids are whole numbers; others raise a TypeError. Words are what stands between spaces and U+0009 to U+000D; ``kept`` joins the kept ones by one
    space. Whether an edge is repeated is judged on the input. Documents of fewer than ``k`` words lose
    nothing, a null text has no words. Rows that share an id are compared like other documents,
    save that the same words at the same start do not count as earlier. A null id is never compared.
    With ``carry`` a column ``row`` follows, a struct of the other columns of ``docs``, and ``kept`` is the
    text as it was (null for a null text) where nothing is removed. An empty table gives no row; extra
    columns may have any names; a document is worked on whole, however long.
    """
    spans = repeated_spans(docs, id_col, text_col, k)
    per_doc = spans.groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))

    others = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), variant_of(text_col).alias("variant"), row.alias("row"), F.col(text_col).alias("z"))
    packed = T.StructType([f for f in rows.schema.fields[:3]] + [T.StructField("z", T.BinaryType())])
    stripped = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), rows.schema["row"]]
    )

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=6)
        for b in batches:
            z = [c.compress(x.encode()) if (x := t.as_py()) is not None else None for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(z, pa.binary())], names=["doc", "variant", "row", "z"])

    def strip(batches):
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for z, spans in zip(part.column(1), part.column(2)):
                    raw = d.decompress(z.as_py()) if z.is_valid else None
                    words = (raw or b"").split()
                    spans = spans.as_py() or []
                    if spans:
                        gone = np.zeros(len(words) + 1, np.int64)
                        s = np.array([(x["start"], x["n_words"]) for x in spans])
                        np.add.at(gone, s[:, 0], 1)
                        np.add.at(gone, s[:, 0] + s[:, 1], -1)
                        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                        kept = [words[i] for i in stay.tolist()]
                    else:
                        kept = words
                    text = raw if carry and len(kept) == len(words) else b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), text.decode() if text is not None else None))
                n, r, t = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.string()), part.column(3)], names=[id_col, "n_words", "n_removed", "kept", "row"])

    small = rows.mapInArrow(squeeze, packed)
    out = small.join(per_doc, ["doc", "variant"], "left").select("doc", "z", "spans", "row").mapInArrow(strip, stripped)
    return out if carry else out.drop("row")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20) -> DataFrame:
    """``docs`` with the kept words as text where words were removed; other rows keep their text as it is."""
    done = remove_repeats(docs, id_col, text_col, k, carry=True)
    named = {id_col: F.col(f"`{id_col}`").cast(docs.schema[id_col].dataType), text_col: F.col("kept")}
    return done.select(*[named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
