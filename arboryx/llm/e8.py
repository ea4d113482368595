"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .common import components, tiled
from .topk import finite

#: Vectors of a block of a large cell; a task holds two blocks at a time.
BLOCK_ROWS = 2048
#: Cells of up to this many entries share a task with others, about BATCH_ROWS entries in all.
SMALL_CELL = 64
BATCH_ROWS = 2_000
#: (most vectors, tables, E8 blocks of a table, scale of the projections). Measured in 64 dimensions with 8 probes: at
#: the threshold of 0.95 a pair meets in some table with a probability above 0.95, and by chance a vector meets fewer
#: than 7 others in each table up to the most vectors of a line; beyond the last line chance meetings grow.
SETTINGS = ((100_000, 8, 1, 3.7), (1_000_000, 8, 2, 2.0), (10_000_000, 9, 3, 1.5), (40_000_000, 11, 4, 1.25), (400_000_000, 18, 6, 1.0))


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points whose integer coordinates have an even sum: round, and if the sum is odd, round
    the coordinate farthest from its integer the other way."""
    r = np.rint(x)
    off = x - r
    odd = r.sum(axis=1) % 2 != 0
    at = np.abs(off).argmax(axis=1)
    rows = np.flatnonzero(odd)
    r[rows, at[rows]] += np.where(off[rows, at[rows]] >= 0, 1.0, -1.0)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled so that they are integers: E8 is D8 and D8 shifted by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    whole = [[2 * s if i == p else 2 * t if i == q else 0 for i in range(8)] for p, q in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(whole + half, np.int64)


def setting(n: int) -> tuple[int, int, float]:
    """(tables, blocks, scale) for ``n`` vectors; cells become finer as vectors become more."""
    return next((x[1:] for x in SETTINGS if n <= x[0]), SETTINGS[-1][1:])


class Tables:
    """Several lattice hash tables over vectors of one length: a home cell and probed neighbours each.

    A table projects into ``blocks`` times 8 dimensions at random and decodes each 8 to a point of E8;
    the points together are the home cell. A neighbouring cell has a neighbouring point in one block.
    """

    def __init__(self, dim: int, tables: int, probes: int, blocks: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.maps = rng.standard_normal((tables, blocks, dim, 8)) * (scale / np.sqrt(8))
        self.shifts = rng.random((tables, blocks, 8)) * 2
        self.mix = (rng.integers(0, 2**63, 8, dtype=np.int64) * 2 + 1).view(np.uint64)
        self.start = rng.integers(0, 2**63, blocks, dtype=np.int64).view(np.uint64)
        self.tables, self.probes, self.blocks, self.around = tables, probes, blocks, minimal_vectors()

    def _name(self, points: np.ndarray, block) -> np.ndarray:
        h = np.broadcast_to(self.start[block], points.shape[:-1]).copy()
        for i in range(8):
            h = (h ^ points[..., i].astype(np.uint64)) * self.mix[i]
            h ^= h >> np.uint64(29)
        return h

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Names of cells, (n, tables, 1 + probes): the home cell, then the neighbours nearest to the vector."""
        n, row = len(unit), np.arange(len(unit))[:, None]
        out = np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            homes, names, leans = [], [], []
            for j in range(self.blocks):
                y = unit @ self.maps[t, j] + self.shifts[t, j]
                home = decode(y)
                homes.append(home)
                names.append(self._name(home, j))
                leans.append((2 * y - home) @ self.around.T)  # all neighbours are equally long: the nearest has the largest product
            whole = np.add.reduce(names)
            out[:, t, 0] = whole.view(np.int64)
            if self.probes:
                near = np.argpartition(-np.concatenate(leans, axis=1), self.probes - 1, axis=1)[:, : self.probes]
                block, step = np.divmod(near, len(self.around))
                points = np.stack(homes, axis=1)[row, block] + self.around[step]
                other = whole[:, None] - np.stack(names, axis=1)[row, block] + self._name(points, block)
                out[:, t, 1:] = other.view(np.int64)
        return out


def _meet(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """For pairs of cell arrays (pairs, tables, 1 + probes): where one's home is a cell of the other."""
    return (cx[:, :, :1] == cy).any(axis=2) | (cx == cy[:, :, :1]).any(axis=2)


def _in_small(group: np.ndarray):
    """All pairs of rows of the same (sorted) group, by their distance in the order."""
    for step in range(1, len(group)):
        i = np.flatnonzero(group[step:] == group[:-step])
        if not len(i):
            return
        yield i, i + step


def _in_large(group: np.ndarray, unit: np.ndarray, threshold: float):
    """Pairs of rows of the same (sorted) group whose cosine is about the threshold or more."""
    for g in np.unique(group):
        lo, hi = np.searchsorted(group, [g, g + 1])
        for at in range(lo, hi, 256):
            to = min(at + 256, hi)
            i, j = np.nonzero(unit[at:to] @ unit[at:hi].T >= threshold - 1e-9)
            ahead = i < j
            for part in range(0, int(ahead.sum()), 50_000):
                yield at + i[ahead][part : part + 50_000], at + j[ahead][part : part + 50_000]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tables: int | None = None, blocks: int | None = None, scale: float | None = None, probes: int = 8, seed: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine at least ``threshold`` that meet in a lattice cell of some table.

    Returns one row per row of ``vectors``: (id, n_links long, component_id, kept boolean). Every
    vector is put into its home cell and into its ``probes`` nearest neighbouring cells in each
    table; a pair meets where the home cell of one is a cell of the other. Cosines of pairs that meet
    are checked in double precision on the whole vectors. No pair leaves a task: a pair is counted in
    the first table where it meets (there in the cell of the smaller name if it meets in two), tasks
    give each vector's count and a spanning forest of the links they saw. Equal vectors are one
    entry with a weight, so copies of a vector cost no pairs; cells of more than BLOCK_ROWS entries
    are split into pairs of blocks. ``n_links`` never counts below the threshold; how many of all links are found is
    a matter of ``tables``, ``blocks``, ``scale`` (by default those of SETTINGS for the number of different
    vectors) and ``probes``, and measured in the tests.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, and
    vectors of different lengths do not link. Repeated ids with equal vectors link with each other. A
    row without an id links like any other, but names no component: one of only such rows is null, and
    its rows are kept; in a component with an id they are not. An empty table gives no row; extra
    columns are not looked at.
    """
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x")))
    good = rows.where(finite(F.col("x")) & F.exists("x", lambda v: v != 0))
    entries = cut(good.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    entries = entries.withColumn("rep", F.monotonically_increasing_id())  # a checkpoint's numbering holds
    usual = setting(entries.count())
    shape = tuple(given if given is not None else x for given, x in zip((tables, blocks, scale), usual))
    tables = shape[0]

    def tables_of(dim: int) -> Tables:
        return Tables(dim, shape[0], probes, shape[1], shape[2], seed)

    def unit(x: pd.Series) -> np.ndarray:
        a = np.stack(x.to_numpy()).astype(np.float64)
        a = a / np.abs(a).max(axis=1, keepdims=True)  # keeps squares of huge and tiny components finite
        return a / np.sqrt((a * a).sum(axis=1, keepdims=True))

    def place(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["x"].map(len)):
                cells = tables_of(dim).cells(unit(part["x"]))
                n, per = len(part), tables * (1 + probes)
                again = np.repeat(np.arange(n), per)
                yield pd.DataFrame({
                    "t": np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n),
                    "cell": cells.reshape(-1),
                    "home": np.tile(np.arange(per) % (1 + probes) == 0, n),
                    "dim": np.int32(dim),
                    "rep": part["rep"].to_numpy()[again],
                })

    # cells are named first without the vectors, so that only shared cells carry them
    named = entries.select("rep", "x").mapInPandas(place, "t int, cell long, home boolean, dim int, rep long")
    keyed = cut(named)
    shared = cut(keyed.groupBy("t", "cell", "dim").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home"))
    batches = math.ceil((shared.where(F.col("n") <= SMALL_CELL).agg(F.sum("n")).first()[0] or 1) / BATCH_ROWS)
    met = keyed.join(shared.select("t", "cell", "dim", "n"), ["t", "cell", "dim"])
    of_cell = F.xxhash64("t", "cell")
    alone = F.lit(-1)
    small = met.where(F.col("n") <= SMALL_CELL).select("*", alone.alias("block"), alone.alias("tile_a"), alone.alias("tile_b"), F.pmod(of_cell, F.lit(batches)).alias("g")).drop("n")
    large = tiled(met.where(F.col("n") > SMALL_CELL).drop("n"), ["t", "cell", "dim"], "rep", BLOCK_ROWS).withColumn("g", of_cell)
    full = cut(small.unionByName(large)).join(entries, "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "cell", "rep"])
        t, cell, rep, home, block, weight = (pdf[c].to_numpy() for c in ("t", "cell", "rep", "home", "block", "weight"))
        u, crossing = unit(pdf["x"]), pdf["tile_a"].iloc[0] != pdf["tile_b"].iloc[0]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (cell[1:] != cell[:-1])])
        group, tab = np.cumsum(new), tables_of(u.shape[1])
        names, node = np.unique(rep, return_inverse=True)
        count, parent, left, right = np.zeros(len(names), np.int64), list(range(len(names))), [], []
        for i, j in _in_small(group) if pdf["tile_a"].iloc[0] < 0 else _in_large(group, u, threshold):
            ok = home[i] | home[j]
            if crossing:
                ok &= block[i] != block[j]
            i, j = i[ok], j[ok]
            close = (u[i] * u[j]).sum(axis=1) >= threshold
            i, j = i[close], j[close]
            if not len(i):
                continue
            # of all places where a pair meets, one counts it: the first table, there the cell of the smaller name
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            cells = tab.cells(u[some])
            cx, cy = cells[at[: len(i)]], cells[at[len(i) :]]
            first, row = _meet(cx, cy).argmax(axis=1), np.arange(len(i))
            hx, hy = cx[row, first, 0], cy[row, first, 0]
            in_x, in_y = (cy[row, first] == hx[:, None]).any(axis=1), (cx[row, first] == hy[:, None]).any(axis=1)
            where = np.where(in_x & in_y, np.minimum(hx, hy), np.where(in_x, hx, hy))
            mine = (first == t[i]) & (where == cell[i])
            i, j = i[mine], j[mine]
            np.add.at(count, node[i], weight[j])
            np.add.at(count, node[j], weight[i])
            for p, q in zip(node[i].tolist(), node[j].tolist()):
                p, q = _root(parent, p), _root(parent, q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(p)
                    right.append(q)
        some = np.flatnonzero(count)
        links = pd.DataFrame({"a": names[some], "b": names[some], "n": count[some]})
        return pd.concat([links, pd.DataFrame({"a": names[left], "b": names[right], "n": np.int64(0)})])

    seen = cut(full.groupBy("dim", "g", "tile_a", "tile_b").applyInPandas(compare, "a long, b long, n long"))
    counts = seen.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = components(seen.where("n = 0"))
    classed = cut(
        entries.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
        .select("x", "id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    classes = classed.join(classed.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("x", "n_links", "component_id")
    usable = finite(F.col("x")) & F.exists("x", lambda v: v != 0)
    joined = rows.withColumn("x", F.when(usable, F.col("x"))).alias("l").join(classes.alias("r"), F.col("l.x") == F.col("r.x"), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i
