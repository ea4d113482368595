"""Alignment of two tokenizers' tokens by the bytes at which they end, in lockstep over a batch of documents."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import shared_folder

#: Text that one task aligns at a time; the pairs of a chunk are counted together.
CHUNK_BYTES = 4 << 20
#: Tokens after which a document goes on in a lane of its own, and how far a common end is looked for.
LANE, LOOK = 4096, 256
#: How the byte-level file splits texts before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it is printed, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers: their ids of texts, and each id's bytes.

    A is a byte-level BPE file whose merges are numbered in their order, so that ids are ranks; special
    tokens' strings inside texts are ordinary text. B is a sentencepiece file that puts a space before
    the text, here part of A's text.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            told = json.load(f)
        alphabet, special = byte_alphabet(), {t["id"] for t in told["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in told["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n_a, n_b = max(ranks.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * n_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(n_b))]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # what a token adds to the text of groups: in a group, at its end, and B's at the document's end
        self.said = [b"%d%s" % (i, c) for i in range(n_a) for c in (b",", b"|")] + [b"%d%s" % (i, c) for i in range(n_b) for c in (b",", b";", b"")]

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and B of each text; none for empty texts and those whose bytes A or B does not give back."""
        none, out = np.empty(0, np.int32), []
        for at in range(0, len(texts), 256):
            some = [t or "" for t in texts[at : at + 256]]
            for text, b in zip(some, self.b.encode(some, num_threads=1)):
                whole = " " + text
                a = self.a.encode_ordinary(whole) if text else []
                same = a and b"".join(map(self.bytes_a.__getitem__, a)) == whole.encode() == b"".join(map(self.bytes_b.__getitem__, b))
                out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else (none, none))
        return out


@lru_cache(maxsize=2)
def shared_pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each A token the B token that ends where it does, or -1.

    Lane k goes through A's tokens from ``i[k]`` to ``stop[k]`` and B's from ``j[k]`` on; the last of both end
    together. All lanes take a step at a time: of the two tokens under its pointers the one that ends
    first is passed, or both with a link and a cut. Finished lanes leave the state vectors.
    """
    match = np.full(len(ends_a), -1, np.int32)
    while len(i):
        a, b = ends_a[i], ends_b[j]
        both = a == b
        match[i[both]] = j[both]
        i, j = i + (a <= b), j + (b <= a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    return match


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, last_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lanes start in A and B and stop in A: one for each document, and further ones inside long documents.

    After every LANE tokens the next common end begins a lane, if there is one among LOOK tokens; else the
    lane just goes on.
    """
    n = last_a - first_a
    cuts = np.concatenate([np.arange(f + LANE, e - LOOK, LANE) for f, e in zip(first_a[n > LANE + LOOK], last_a[n > LANE + LOOK])] or [np.empty(0, np.int64)])
    starts_a, starts_b = [first_a], [first_b]
    for _ in range(LOOK):
        if not len(cuts):
            break
        at = np.searchsorted(ends_b, ends_a[cuts])
        found = ends_b[at] == ends_a[cuts]
        starts_a.append(cuts[found] + 1)
        starts_b.append(at[found] + 1)
        cuts = cuts[~found] + 1
    i, j = np.concatenate(starts_a), np.concatenate(starts_b)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    return i, j, np.append(i[1:], last_a[-1:])


def align_chunk(pair: Pair, texts: list[str | None]) -> dict:
    """Counts, group digests and links of documents that are aligned together."""
    ids = pair.ids(texts)
    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    a, b = (np.concatenate([x[k] for x in ids] or [np.empty(0, np.int32)]) for k in (0, 1))
    del ids
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])  # both run on over all documents, of as many bytes
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    has = n_a > 0
    match = lockstep(ends_a, ends_b, *lanes(ends_a, ends_b, (last_a - n_a)[has], last_a[has], (last_b - n_b)[has]))
    link_a = np.flatnonzero(match >= 0)
    link_b = match[link_a]
    doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
    n_links = np.bincount(doc, minlength=len(texts))
    # each link ends a group: A's tokens of the group, then B's
    ends_group_a, ends_group_b = np.zeros(len(a), np.int32), np.zeros(len(b), np.int32)
    ends_group_a[link_a] = 1
    ends_group_b[link_b] = 1
    group_a, group_b = np.cumsum(ends_group_a, dtype=np.int32) - ends_group_a, np.cumsum(ends_group_b, dtype=np.int32) - ends_group_b
    ends_group_b[last_b[has] - 1] = 2
    said = np.empty(len(a) + len(b), np.int32)
    said[np.arange(len(a)) + np.concatenate([[0], link_b[:-1] + 1])[group_a] if len(a) else []] = 2 * a + ends_group_a
    said[np.arange(len(b)) + (link_a + 1)[group_b] if len(b) else []] = 2 * len(pair.bytes_a) + 3 * b + ends_group_b
    digests, at = [], 0
    for n in (n_a + n_b).tolist():
        text = b"".join(map(pair.said.__getitem__, said[at : at + n].tolist()))
        digests.append(hashlib.sha256(text).hexdigest() if n else "")
        at += n
    links = a[link_a].astype(np.int64) << 32 | b[link_b]
    return {"n_a": n_a, "n_b": n_b, "n_links": n_links, "groups_sha256": digests, "links": links}


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A link is an A token and a B token that end at the same byte of the space and the text; every such byte
    is a cut too, so a document has a group per link. Counts of linked id pairs are taken over all rows.

    1. Tasks align chunks of their documents in lockstep and count a chunk's own pairs. Stored per document:
       its links as numbers into the chunk's list of pairs; and that list once per chunk.
    2. The chunks' counts are added up per pair, and each B id's highest is found (a row per B id: broadcast).
    3. Each chunk's list gets the counts back and meets the chunk's documents. A common pair has a row per
       chunk there, never one per link.

    Null and empty texts, and texts whose bytes A's or B's tokens do not give back (U+2581 in the text, for
    one), have no tokens: zeros, and an empty groups_sha256. Repeated rows count each, rows without an id like
    others. A very long text is aligned in several lanes. An empty table gives no row; other columns are not looked at.
    """
    kind, spark = dict(docs.dtypes)[id_col], docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    names = ["chunk", "id", "n_a", "n_b", "n_links", "groups_sha256", "links", "pairs", "times"]

    def work(batches):
        pair, number, held, texts, size = shared_pair(path_a, path_b), TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            found = align_chunk(pair, texts)
            pairs, codes, times = np.unique(found["links"], return_inverse=True, return_counts=True)
            common = np.argsort(-times, kind="stable")  # small numbers for common pairs: they compress
            place = np.empty(len(pairs), "<i4")
            place[common] = np.arange(len(pairs))
            codes, ends = place[codes], np.cumsum(found["n_links"])
            n = len(texts)
            columns = [
                pa.array(np.full(n, number)), pa.concat_arrays(held), *[pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_links")], pa.array(found["groups_sha256"]),
                pa.array([codes[s:e].tobytes() for s, e in zip(ends - found["n_links"], ends)], pa.binary()),
                pa.array([pairs[common]] + [None] * (n - 1), pa.list_(pa.int64())), pa.array([times[common]] + [None] * (n - 1), pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part.column(0))
                texts += part.column(1).to_pylist()
                size += part.column(1).nbytes
                if size >= CHUNK_BYTES:
                    yield out()
                    number, held, texts, size = number + 1, [], [], 0
        if texts:
            yield out()

    schema = f"chunk long, id {kind}, n_a long, n_b long, n_links long, groups_sha256 string, links binary, pairs array<long>, times array<long>"
    folder = f"{shared_folder(spark)}/align-{uuid.uuid4().hex}"
    rows.mapInArrow(work, schema).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(schema).parquet(folder)

    listed = stored.where("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("code", "p")).select("chunk", "code", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = listed.groupBy("pair").agg(F.sum("times").alias("n"))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # at most a row per id of B's vocabulary
    known = counts.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    lookup = listed.select("chunk", "code", "pair").join(known, "pair").select("chunk", "code", "n", "best")

    def add_up(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        code = found["code"].to_numpy()
        n[code], best[code] = found["n"].to_numpy(), found["best"].to_numpy()
        links = [np.frombuffer(x, "<i4") for x in own["links"]]
        sums = {"n_best": [int(best[x].sum()) for x in links], "count_sum": [int(n[x].sum()) for x in links]}
        return own.drop(columns=["chunk", "links"]).assign(**sums)[["id", "n_a", "n_b", "n_links", "n_best", "count_sum", "groups_sha256"]]

    own = spark.read.schema(schema).parquet(folder).select("chunk", "id", "n_a", "n_b", "n_links", "groups_sha256", "links")
    out = own.groupBy("chunk").cogroup(lookup.groupBy("chunk")).applyInPandas(add_up, f"id {kind}, n_a long, n_b long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
