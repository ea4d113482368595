"""A stored inverted-file index for approximate nearest neighbours by cosine.

Vectors are dealt to the list of their nearest centroid and stored by list, so a search reads only the
lists that its queries probe. Centroids are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboryx.functions.vectors import l2_normalise
from arboryx.lineage import cut
from arboryx.operators.ranking import nearest, top

#: Most lists, sampled vectors for each in fitting, rounds of fitting, vectors of a list that meet the queries in one task.
MOST_LISTS, SAMPLE_PER_LIST, ROUNDS, BLOCK_ROWS = 4096, 64, 12, 16384
#: Sampled queries by which the number of probes is set.
MEASURED = 256


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix of unit rows; zero rows stay zero."""
    x = np.array(column.to_pylist(), np.float64)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def fit_centroids(vectors: DataFrame, lists: int | None = None) -> np.ndarray:
    """Centroids (a row each, of length 1) by rounds of spherical k-means over at most lists * SAMPLE_PER_LIST vectors.

    The sample is that of the smallest hashes of ids, so a rerun agrees. ``lists`` is the root of the
    number of vectors unless it is given, MOST_LISTS at most. Empty centroids take the vectors that fit worst.
    """
    n = vectors.count()
    lists = min(lists or max(1, round(math.sqrt(n))), MOST_LISTS, max(1, n))
    sample = vectors.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(lists * SAMPLE_PER_LIST).select("v").toPandas()  # bounded
    if not len(sample):
        return np.zeros((1, 1))
    x = _matrix(pa.array(sample["v"].tolist()))
    lists = min(lists, len(x))
    centre = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        score = x @ centre.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(score.max(axis=1), kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centre)
    return centre


def _placed(vectors: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """``vectors`` (id, v) with their ``probes`` nearest lists, a row for each with its place from 0; the centroids travel with the task, MOST_LISTS at most."""
    kind = dict(vectors.dtypes)["id"]

    def place(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                score = np.round(_matrix(part.column(1)) @ centre.T, 9)
                near = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                rows = np.repeat(np.arange(len(near)), near.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(near.shape[1], dtype=np.int32), len(near)))], names=["id", "v", "list", "place"])

    return vectors.select("id", "v").where("v IS NOT NULL").mapInArrow(place, f"id {kind}, v array<double>, list int, place int")


def build(vectors: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, k: int = 16) -> None:
    """Writes the index of ``vectors`` (id, v array<double> of one length) to ``path``; null vectors are left out.

    ``path/lists`` has a folder per list, ``path/centroids`` (list, centre, n, probes). ``probes`` is the number of lists
    after which MEASURED vectors have found ``recall`` of their exact k neighbours: many where vectors have no
    structure, few where they have. One writer at a time; an index that is there is replaced.
    """
    centre = fit_centroids(vectors.where("v IS NOT NULL").select("id", "v"), lists)
    placed = _placed(vectors, centre, 1).drop("place")
    vectors.select("id").limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")  # the type of ids, also of an empty index
    # rows of a list go to several tasks, if it is large, and so to several files
    placed.repartition(F.col("list"), F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    sizes = _stored(spark, path).groupBy("list").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centre)], "list int, centre array<double>")
    probes = _needed_probes(spark, path, centre, recall, k)
    rows.join(sizes, "list", "left").select("list", "centre", F.coalesce("n", F.lit(0)).alias("n"), F.lit(probes).alias("probes")).write.mode("overwrite").parquet(f"{path}/centroids")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    kind = dict(spark.read.parquet(f"{path}/kind").dtypes)["id"]
    return spark.read.schema(f"id {kind}, v array<double>, list int").parquet(f"{path}/lists")


def _needed_probes(spark: SparkSession, path: str, centre: np.ndarray, recall: float, k: int) -> int:
    """How many lists a query must probe so that the share ``recall`` of exact neighbours lies in them, over MEASURED sampled queries."""
    stored = _stored(spark, path).select("id", l2_normalise(F.col("v")).alias("v"), "list")
    some = cut(stored.orderBy(F.xxhash64("id", F.lit("measured")), "id").limit(MEASURED).select("id", "v"))
    near = nearest(stored.select("id", "v"), some, k).select("query_id", "id").join(stored.select("id", "list"), "id")
    places = _placed(some, centre, len(centre)).select(F.col("id").alias("query_id"), "list", "place")
    found = np.sort([r[0] for r in near.join(places, ["query_id", "list"]).select("place").collect()])  # MEASURED * k at most
    return int(found[min(len(found) - 1, math.ceil(recall * len(found)) - 1)]) + 1 if len(found) else 1


def probed(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """(id, v, list) of the lists named; the others are not read, since they are other folders."""
    return _stored(spark, path).where(F.col("list").isin(lists))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 16, probes: int | None = None, least: float | None = None) -> DataFrame:
    """(query_id, id, cosine, rank): the k nearest of each query (id, v) among the vectors of its ``probes`` nearest
    lists (as many as the index has measured to be enough, unless given).

    Cosines are those of the vectors themselves. A vector of the query's own id is left out; ties go to the
    smaller id; with ``least`` only cosines of at least that count. As many probes as lists give the exact result.
    """
    told = spark.read.parquet(f"{path}/centroids").orderBy("list").toPandas()  # a row per list
    centre, sizes = np.array(told["centre"].tolist()), dict(zip(told["list"].tolist(), told["n"].tolist()))
    queries = queries if any(sizes.values()) else queries.limit(0)  # an empty index has no dimensions
    asked = cut(_placed(queries, centre, min(probes or int(told["probes"].iloc[0]), len(centre))).drop("place"))
    wanted = [r[0] for r in asked.select("list").distinct().collect()]  # lists at most
    parts = F.create_map(*[F.lit(x) for i in wanted for x in (i, max(1, -(-sizes[i] // BLOCK_ROWS)))]) if wanted else F.create_map(F.lit(0), F.lit(1))
    n = parts[F.col("list")]
    left = probed(spark, path, wanted).withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int"))
    right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    kinds = dict(left.dtypes)["id"], dict(queries.dtypes)["id"]

    def meet(found: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names, out = ["query_id", "id", "cosine"], []
        if len(found) and len(ask):
            found = found.sort_values("id", kind="stable")
            x, ids = _matrix(pa.array(found["v"].tolist())), found["id"].to_numpy()
            for at in range(0, len(ask), 256):
                some = ask.iloc[at : at + 256]
                own = some["id"].to_numpy()
                s = np.round(_matrix(pa.array(some["v"].tolist())) @ x.T, 9)
                ok = ids[None, :] != own[:, None]
                if least is not None:
                    ok &= s >= least
                s = np.where(ok, s, -np.inf)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                i, j = np.nonzero(np.take_along_axis(ok, best, axis=1))
                out.append(pd.DataFrame(dict(zip(names, (own[i], ids[best[i, j]], s[i, best[i, j]])))))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    met = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(meet, f"query_id {kinds[1]}, id {kinds[0]}, cosine double")
    return top(met, ["query_id"], [F.desc("cosine"), F.col("id")], k)
