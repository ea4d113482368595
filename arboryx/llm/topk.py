"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

The dimensions are orthogonal axes fitted to a bounded sample of the vectors, so that the leading ones
hold most of every product, and one more list has what is left of each vector's length. Blocks of
queries go down the lists of a block of candidates together; scores are integers and exact.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut

#: Candidates of a block, whose lists a task sorts, and queries that go down them together.
BLOCK_ROWS = 16384
QUERY_ROWS = 2048
#: Vectors that the axes are fitted to at most (they change how soon a search stops, never its result), and the share
#: of their squared length that the axes with lists of their own hold.
SAMPLE_ROWS = 4096
LISTED_SHARE = 0.75
#: Products up to here are exact in floating point; larger ones are formed in Python's integers.
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1


def finite(vector: Column) -> Column:
    """True where a vector is there, not empty, and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, x array<double>): floor(scale * component) as a whole number; rows that take no part are left out."""
    most = F.lit(1.7e308)

    def floor(v: Column) -> Column:  # F.floor would give longs, which hold less than doubles do
        y = F.greatest(F.least(v.cast("double") * F.lit(float(scale)), most), -most)
        return F.rint(y) - F.when(F.rint(y) > y, 1.0).otherwise(0.0)

    return rows.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), floor).alias("x"))


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal rows: the leading axes of a sample, as many as hold LISTED_SHARE of its squared length."""
    longest = np.abs(sample).max(initial=0.0)
    if not longest:
        return np.eye(sample.shape[1])[:1]
    a = sample / longest
    held, axes = np.linalg.eigh(a.T @ a)
    held = np.maximum(held[::-1], 0)
    return axes.T[::-1][: 1 + int(np.searchsorted(np.cumsum(held), LISTED_SHARE * held.sum()))]


def _exact(x: np.ndarray, q: np.ndarray) -> int:
    """An inner product in Python's integers, held within 64 bits."""
    return min(max(sum(int(a) * int(b) for a, b in zip(x.tolist(), q.tolist())), LEAST), MOST)


class SortedLists:
    """Candidates of one block with an order of them per axis, and one by the length off the axes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, axes: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x, self.axes = ids[by_id], x[by_id], axes
        with np.errstate(over="ignore", invalid="ignore"):
            along = self.x @ axes.T
            square = (self.x * self.x).sum(axis=1)
            off = np.sqrt(np.maximum(square - (along * along).sum(axis=1), 0))
            self.length = float(np.sqrt(square.max(initial=0)))
        lists = np.concatenate([along, off[:, None]], axis=1)
        self.order = np.argsort(lists, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(lists, self.order, axis=0)
        self.widest = np.abs(self.x).max(axis=1, initial=0)
        self.scored = 0

    def top(self, asked: np.ndarray, q: np.ndarray, k: int, least: np.ndarray):
        """(query number, score, candidate's place) of all that can be among the k best of ``asked``.

        ``least`` is a score that k other candidates of each query are known to reach. Sorted access
        goes down all lists at once, from both ends, in steps that double; candidates that turn up are
        scored by random access. A query stops when its threshold, the best score that a candidate
        not seen yet could have, falls below its k-th score; not at it, since an unseen tie could have a
        smaller id. Candidates with the query's own id are passed over.
        """
        n, last = len(self.ids), len(self.axes)
        with np.errstate(over="ignore"):
            wide = np.abs(q).sum(axis=1)
            plain = self.widest.max(initial=0) * wide.max(initial=0) < EXACT
        kind = np.float64 if plain else np.int64
        low, found = least.astype(kind), [np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64)]
        with np.errstate(over="ignore", invalid="ignore"):
            along = q @ self.axes.T
            square = (q * q).sum(axis=1)
            off, length = np.sqrt(np.maximum(square - (along * along).sum(axis=1), 0)), np.sqrt(square)
        up, down = np.maximum(along, 0), np.minimum(along, 0)
        slack = 1e-6 * length * self.length + 1e-6  # for what the axes and the lengths are rounded by
        seen, depth, live = np.zeros(n, bool), 0, np.arange(len(q))
        while len(live) and depth < n:
            at = min(depth, n - 1)
            with np.errstate(over="ignore", invalid="ignore"):
                bound = up[live] @ self.sorted[n - 1 - at, :last] + down[live] @ self.sorted[at, :last] + off[live] * self.sorted[n - 1 - at, last]
                bound = np.minimum(bound, length[live] * self.length) + slack[live]
                live = live[~(bound < low[live])]
            if not len(live):
                break
            to = min(n, 2 * depth + 16)
            rows = np.concatenate([self.order[depth:to, :last].ravel(), self.order[n - to : n - depth].ravel()])
            mark = np.zeros(n, bool)
            mark[rows] = True
            fresh = np.flatnonzero(mark & ~seen)
            seen |= mark
            depth = n if seen.all() else to
            for lo in range(0, len(fresh), 1024):
                some = fresh[lo : lo + 1024]
                s = q[live] @ self.x[some].T if plain else self._wide(q[live], wide[live], some)
                self.scored += s.size
                own = self.ids[some][None, :] == asked[live][:, None]
                good = (s >= low[live][:, None]) & ~own
                if good.sum() > 4 * k * len(live) and len(some) > k:  # the k-th of these alone is a better least score
                    kth = np.partition(np.where(own, kind(LEAST), s), len(some) - k, axis=1)[:, len(some) - k]
                    low[live] = np.maximum(low[live], kth)
                    good = (s >= low[live][:, None]) & ~own
                i, j = np.nonzero(good)
                found = self._best([np.concatenate(x) for x in zip(found, (live[i], s[i, j], some[j]))], k, low)
        return found[0], found[1].astype(np.int64), found[2]

    def _wide(self, q: np.ndarray, wide: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Scores as 64-bit integers where floating point alone would round some of them."""
        with np.errstate(over="ignore", invalid="ignore"):
            s, large = q @ self.x[some].T, wide[:, None] * self.widest[some][None, :] >= EXACT
        out = np.where(large, 0, s).astype(np.int64)
        for i, j in zip(*np.nonzero(large)):
            out[i, j] = _exact(self.x[some[j]], q[i])
        return out

    @staticmethod
    def _best(found: list[np.ndarray], k: int, low: np.ndarray) -> list[np.ndarray]:
        """The k best of each query, ties to the smaller place; raises ``low`` where k are there."""
        query, score, place = found
        by = np.lexsort([place, -score if score.dtype.kind == "f" else ~score, query])
        query, score, place = query[by], score[by], place[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kth = rank == k - 1
        low[query[kth]] = np.maximum(low[query[kth]], score[kth])
        keep = rank < k
        return [query[keep], score[keep], place[keep]]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of ``vectors`` with the largest integer inner product for each row of ``queries``.

    Returns (query_id, rank from 1, id, score). A row is no candidate for a query with its own id.
    Candidates are dealt evenly into blocks. Each query first searches one block; its k-th score there
    is where the searches of all other blocks start, so that a block gives back only what can be
    among the k best, and stops at once where nothing can.

    Vectors that are null, empty or hold a null or non-finite component, and rows without an id, take no part; vectors of
    another length than a query's are no candidates for it. Rows that repeat an id each count, as
    candidates and as queries (a repeated query has its ranks again). Ties go to the smaller id.
    Scores beyond 64 bits are held at the nearest 64-bit number and rank as that. An empty table
    gives no row; extra columns are not looked at.
    """
    numbered = F.monotonically_increasing_id()  # holds, since a checkpoint is read
    dim = F.size("x").alias("dim")
    cands, asked = cut(quantised(vectors, id_col, vector_col, scale)), cut(quantised(queries, id_col, vector_col, scale))
    kind = dict(cands.dtypes)["id"]
    blocks, parts = max(1, math.ceil(cands.count() / BLOCK_ROWS)), max(1, math.ceil(asked.count() / QUERY_ROWS))
    dealt = cands.select("id", "x", dim, F.pmod(F.xxhash64(numbered), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.select("id", "x", dim, numbered.alias("number")).withColumns({
        "home": F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"),
        "part": F.pmod(F.xxhash64("number", F.lit("part")), F.lit(parts)).cast("int"),
    })
    sample = cands.orderBy(F.xxhash64("id", "x")).limit(SAMPLE_ROWS).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r.x), []).append(r.x)
    axes = {n: principal_axes(np.array(x)) for n, x in by_length.items()}

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["number", "query_id", "id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        x, q = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        lists = SortedLists(left["id"].to_numpy(), x, axes.get(x.shape[1], np.eye(x.shape[1])))
        at, score, place = lists.top(right["id"].to_numpy(), q, k, right["least"].to_numpy(np.int64))
        return pd.DataFrame(dict(zip(names, (right["number"].to_numpy()[at], right["id"].to_numpy()[at], lists.ids[place], score))))

    def searched(some: DataFrame, copies: DataFrame) -> DataFrame:
        by = ("block", "part", "dim")
        return copies.groupBy(*by).cogroup(some.groupBy(*by)).applyInPandas(search, f"number long, query_id {kind}, id {kind}, score long")

    each = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = searched(asked.withColumns({"block": F.col("home"), "least": F.lit(LEAST)}), each)
    if blocks > 1:
        found = cut(found)
        reached = found.groupBy("number").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        least = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(LEAST)).alias("least")
        others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("home"))
        rest = asked.join(reached, "number", "left").withColumn("least", F.coalesce(least, F.lit(LEAST))).withColumn("block", F.explode(others))
        found = found.union(searched(rest, each))
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "id")).alias("rank")
    return found.select("query_id", rank, "id", "score").where(F.col("rank") <= k)
