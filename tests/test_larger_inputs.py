"""Operators where a larger or an odd input once gave another result, or work that grew with its square."""

import hashlib
import random
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arboryx.functions import text
from arboryx.operators import density, graph, lookup, ranking, registry, resolution, watch
from tests.test_density import brute, frame
from tests.test_registry import by_loop


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_letters_other_than_ascii_end_a_capitalised_word(spark):
    assert one(spark, text.capitalised(F.lit("ÄEnlich Reelleß Heiter, Heiter9 _Erchbe Enlich Kürzer"))) == ["Enlich", "Reelle", "Heiter"]


@pytest.mark.parametrize("few", [registry.FEW_KNOWN, 0])
def test_links_where_mentions_are_and_by_shuffles_are_those_of_a_loop(spark, monkeypatch, few):
    monkeypatch.setattr(registry, "FEW_KNOWN", few)
    rng = random.Random(7)
    vec = lambda: rng.choice([None, [1.0, 0.0], [0.9, 0.3], [0.0, 1.0], [-1.0, 0.2], [0.0, 0.0], [1.0, 0.0, 0.0]])
    rows = [(o, rng.choice(["zeus", "hera", "rhea", "", None]), rng.choice([None, [], rng.sample(["Q1", "Q2", "Q3"], 2)]), vec()) for o in rng.sample(range(500), 60)]
    nodes = [("a", "zeus", ["Q2"], [1.0, 0.0]), ("b", "zeus", None, [0.9, 0.3])]
    df = spark.createDataFrame(rows, "ord long, label string, external array<string>, v array<double>")
    known = spark.createDataFrame(nodes, "node string, label string, external array<string>, v array<double>")

    def loop(mentions):  # vectors of another length never match
        wide = lambda v: None if v is None else ([*v, 0.0, 0.0, 0.0] if len(v) == 2 else [0.0, 0.0, *v])
        return by_loop([(*m[:3], wide(m[3])) for m in mentions], [(*n[:3], wide(n[3])) for n in nodes])

    assert {r.ord: (r.node, r.signal, pytest.approx(r.score)) for r in registry.link_in_order(df, known).collect()} == loop(rows)


def test_mentions_of_one_name_do_not_all_meet(spark):
    """A name of 3,000 mentions with vectors once made 4.5 million pairs in the first round."""
    df = spark.range(3000).selectExpr("id AS ord", "'zeus' AS label", "CAST(NULL AS ARRAY<STRING>) AS external", "array(1.0D, id / 1e6) AS v")
    known = registry.link_in_order(df)
    sizes = []
    linked, registry._linked = registry._linked, lambda own, knows, placed: sizes.append(knows.count()) or linked(own, knows, placed)
    try:
        assert registry.link_in_order(df).groupBy("node").count().collect() == [("m0", 3000)]
    finally:
        registry._linked = linked
    assert max(sizes) == 1 and known.count() == 3000


def test_hash_vectors_hash_each_text_once(spark):
    """Digests were worked out anew for each component of each component: minutes for these rows."""
    began = time.time()
    got = spark.range(20_000).select(watch.unit_vector_of(F.col("id").cast("string"), 64, "part").alias("v")).agg(F.sum(F.col("v")[0]), F.sum(F.col("v")[63])).first()
    assert time.time() - began < 60

    def vector(name):
        raw = b"".join(hashlib.sha256(f"part::{name}".encode() + i.to_bytes(4, "little")).digest() for i in range(8))
        x = np.array(struct.unpack("<64I", raw)) / 2.0**32 * 2 - 1
        return x / np.sqrt((x * x).sum())

    want = [vector(i) for i in range(20_000)]
    assert got[0] == pytest.approx(sum(v[0] for v in want)) and got[1] == pytest.approx(sum(v[63] for v in want))


def test_resolution_is_no_single_plan_of_all_its_copies(spark):
    """Groups of mentions were made four times in one plan of 23 joins, which filled the driver."""
    groups = spark.createDataFrame([("a b", "L0", "A b", 3), ("c", "L1", "c", 1), ("d", "L9", "d", 1)], "form string, ner string, text string, mentions long")
    candidates = spark.createDataFrame([("a b", "en", "Q1"), ("a b", "de", "Q1"), ("a b", "en", "Q2"), ("c", "en", "Q3")], "form string, language string, entity string")
    aliases = spark.createDataFrame([("Q1", "en", "A b", 0), ("Q1", "de", "A b", 0), ("Q2", "en", "a b", 0), ("Q3", "en", "c", 0)], "entity string, language string, alias string, ordinal int")
    types = spark.createDataFrame([("Q1", "odd"), ("Q3", "even")], "entity string, type string")
    accepted = spark.createDataFrame([("L0", None), ("L1", "odd")], "ner string, type string")
    out = resolution.cascade(groups, candidates, aliases, types, accepted, ["en", "de"])
    assert {(r.form, r.tier, r.entity, r.label, r.reason) for r in out.collect()} == {
        ("a b", 3, "Q1", "A b", None), ("c", 0, None, "c", "no candidate of an accepted type"), ("d", 0, None, "d", "label is not looked up"),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6


def test_places_among_all_make_no_row_per_pair(spark, monkeypatch):
    """Ranks took a row for each query and each vector, all of a query's in one task."""
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ranking, "QUERY_ROWS", 7)
    monkeypatch.setattr(ranking, "nearest", None)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 3)).round(1)
    x[50:] = x[:50]  # ties
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = [None if i % 9 == 0 else int(i % 4) for i in range(100)]
    gone = {(q, int(i)) for q in range(0, 100, 5) for i in rng.integers(0, 100, 6)}
    targets = {(q, int(i)) for q in range(0, 100, 5) for i in rng.integers(0, 100, 3) if i != q}
    v = spark.createDataFrame([(i, x[i].tolist(), label[i]) for i in range(100)], "id long, v array<double>, label int")
    s = np.round(x @ x.T, 9)
    for apart in (None, "label"):

        def place(q, t):
            others = [i for i in range(100) if i not in (q, t) and (q, i) not in gone and not (apart and label[i] is not None and label[i] == label[q])]
            return 1 + sum(s[q, i] > s[q, t] for i in others) + sum(s[q, i] == s[q, t] for i in others) / 2

        asked, held = v.where("id % 5 = 0"), [spark.createDataFrame(sorted(p), "query_id long, id long") for p in (targets, gone)]
        got = {(r.query_id, r.id): r["rank"] for r in ranking.places(v, asked, *held, apart=apart).collect()}
        assert got == {(q, t): place(q, t) for q, t in targets}


@pytest.mark.parametrize("seed,m,samples,single,block", [(1, 4, None, False, 1024), (2, 3, 5, False, 10), (3, 3, 1, True, 10), (4, 5, 3, False, 7), (5, 6, 6, False, 16)])
def test_density_clusters_of_many_copies(spark, monkeypatch, seed, m, samples, single, block):
    """Every copy of a vector met all others; tiles hold each vector once now, with the same ties by ids."""
    monkeypatch.setattr(density, "BLOCK_POINTS", block)
    monkeypatch.setattr(density, "PACKS", 2)
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, size=(24, 3)).astype(float)[rng.integers(0, 24, 110)]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    if seed % 2:
        x = x[norm[:, 0] > 0]
    got = {r.id: r.cluster for r in density.density_clusters(frame(spark, x), m, samples, single).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, m, samples or m, single)[0]
    n = len({tuple(v) for v in x.tolist()})
    edges = density.tile_trees(frame(spark, x).selectExpr("id", "v", "1.0D AS core")).where("w is not null").count()
    assert edges <= len(x) + n * (-(-n // block) + 2)


def test_closest_and_equal_labels_make_no_row_per_pair(spark):
    """All nodes of a group met all queries of it, and all nodes of a name all texts that it holds."""
    rng = random.Random(4)
    nodes = [(f"p{i}", rng.randrange(3), rng.choice([1.0, 1.5, 2.0, 2.25, 4.0, 9.0])) for i in range(90)]
    asked = [(i, f"p{i}", nodes[i][1], nodes[i][2]) for i in range(0, 90, 7)] + [(1000, "other", 1, 3.0), (1001, "other", 2, -5.0)]
    got = lookup.closest(spark.createDataFrame(nodes, "id string, grp int, x double"), spark.createDataFrame(asked, "query_id long, own string, grp int, x double"), 4)
    want = {(q, r + 1, n[0]) for q, own, g, x in asked for r, n in enumerate(sorted((n for n in nodes if n[1] == g and n[0] != own), key=lambda n: (abs(n[2] - x), n[0]))[:4])}
    assert {(r.query_id, r["rank"], r.id) for r in got.collect()} == want

    names = [(f"p{i:03d}", ["Red Ring", "red ring", "blue bolt"][i % 3]) for i in range(300)]
    texts = [(q, ["ring", "p004", "b", "zzz"][q % 4]) for q in range(80)]
    found = lookup.search(spark.createDataFrame(names, "id string, label string"), spark.createDataFrame(texts, "query_id long, text string"), limit=5)
    rows = {}
    for r in found.orderBy("query_id", "rank").collect():
        rows.setdefault(texts[r.query_id][1], set()).add((r.query_id, r["rank"], r.id, r.tier))
    reds, blues, every = [n for n, label in names if "ing" in label][:5], [n for n, label in names if "b" in label][:5], range(20)
    assert rows["ring"] == {(4 * q, i + 1, n, 1) for q in every for i, n in enumerate(reds)} and rows["b"] == {(4 * q + 2, i + 1, n, 1) for q in every for i, n in enumerate(blues)}
    assert rows["p004"] == {(4 * q + 1, 1, "p004", 0) for q in every} and "zzz" not in rows


def test_a_neighbourhood_makes_rows_of_starts_last(spark):
    """Rows of a start and a node were shuffled to be given their start's name."""
    edges = spark.createDataFrame([(f"a{i}", f"b{i % 7}", 1.0) for i in range(150)], "src string, dst string, weight double")
    out = graph.neighbourhood(edges, spark.range(150).selectExpr("concat('a', id) AS id"), 2)
    got = {(r.start, r.id, r.distance) for r in out.collect()}
    assert got == {(f"a{i}", f"a{j}", 0 if i == j else 2) for i in range(150) for j in range(150) if i % 7 == j % 7} | {(f"a{i}", f"b{i % 7}", 1) for i in range(150)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("explode")[0]
