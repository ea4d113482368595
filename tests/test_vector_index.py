"""The stored vector index: recall against exact search, and which lists are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arboryx.functions.vectors import l2_normalise
from arboryx.operators import ranking
from arboryx.sources import vector_index


@pytest.fixture(scope="module")
def unit(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), l2_normalise(F.col("embedding")).alias("v")).cache()


@pytest.fixture(scope="module")
def index(unit, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(unit, path)
    return path


def pairs(df):
    return {(r.query_id, r.id): r.cosine for r in df.collect()}


def test_recall_against_exact_search(spark, unit, index, capsys):
    queries = unit.where("id % 10 = 0")
    exact, found = pairs(ranking.nearest(unit, queries, 10)), pairs(vector_index.search(spark, index, queries, 10))
    hits = set(exact) & set(found)
    recall = len(hits) / len(exact)
    with capsys.disabled():
        print(f"\nrecall of the index at 10: {recall:.3f}")
    assert recall >= 0.9 and all(exact[p] == pytest.approx(found[p], abs=1e-8) for p in hits)


def test_all_probes_are_exact(spark, unit, index, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 7)  # every list meets its queries in parts
    queries = unit.where("id % 50 = 0")
    got = {(r.query_id, r.rank): r.id for r in vector_index.search(spark, index, queries, 5, probes=10_000).collect()}
    assert got == {(r.query_id, r.rank): r.id for r in ranking.nearest(unit, queries, 5).collect()}


def test_every_vector_is_indexed_and_only_probed_lists_are_read(spark, unit, index):
    stored = spark.read.parquet(f"{index}/lists")
    assert stored.count() == unit.count() and stored.select("id").distinct().count() == unit.count()
    some = vector_index.probed(spark, index, [0, 3])
    assert {r.list for r in some.select("list").distinct().collect()} <= {0, 3}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    assert all("list=0/" in f or "list=3/" in f for f in some.inputFiles()) or len(some.inputFiles()) == len(stored.inputFiles())
    read = some.groupBy(F.input_file_name().alias("f")).count().collect()
    assert read and all("list=0/" in r.f or "list=3/" in r.f for r in read)


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 2.0]), (5, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    vector_index.build(df, str(tmp_path / "a"), lists=2)
    got = pairs(vector_index.search(spark, str(tmp_path / "a"), df.where("id < 5"), 3, probes=9))
    assert got[1, 2] == 1.0 and got[2, 1] == 1.0 and not any(3 in p for p in got) and got[4, 1] == 0.0
    assert vector_index.search(spark, str(tmp_path / "a"), df.where("id = 1"), 3, probes=9, least=0.5).count() == 1
    none = df.limit(0)
    vector_index.build(none, str(tmp_path / "b"))
    assert np.all(vector_index.fit_centroids(none) == 0) and vector_index.search(spark, str(tmp_path / "b"), df.where("id = 1")).count() == 0
