"""Operators on small inputs worked out by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from arboryx.functions import scalar, text, vectors
from arboryx.operators import evolve, graph, identity, ranking, seeding
from arboryx.sources import text_files
from arboryx.sources.versions import VersionedTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def edges(spark, rows, schema="src string, dst string, weight double"):
    return spark.createDataFrame(rows, schema)


def activation(df):
    return {(r.query_id, r.id): pytest.approx(r.x) for r in df.collect()}


@pytest.fixture
def chain(spark):
    return edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)])


def seeds(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, id string, x double")


def test_chain_raw_keeps_the_last_frontier(spark, chain):
    assert activation(graph.spread(graph.conducting(chain), seeds(spark, ("q", "a", 1.0)), "raw", hops=2)) == {("q", "c"): 0.25}


def test_chain_ppr_loses_what_reaches_the_end(spark, chain):
    got = activation(graph.spread(graph.conducting(chain), seeds(spark, ("q", "a", 1.0)), "ppr", iterations=12))
    assert got == {("q", "a"): 0.15, ("q", "b"): 0.15 * 0.85, ("q", "c"): 0.15 * 0.85**2, ("q", "d"): 0.15 * 0.85**3}


def test_spread_is_additive_and_keeps_parallel_edges(spark):
    e = graph.conducting(edges(spark, [("a", "c", 0.5), ("a", "c", 0.25), ("b", "c", 1.0), ("c", "c", 9.0)]))
    assert activation(graph.spread(e, seeds(spark, ("q", "a", 1.0), ("q", "b", 1.0)), "raw", hops=1, damping=1.0)) == {("q", "c"): 1.75}
    assert graph.spread(e.limit(0), seeds(spark, ("q", "a", 1.0)), "raw").count() == 0


def test_diamond(spark):
    e = graph.conducting(edges(spark, [("0", "1", 1.0), ("0", "2", 1.0), ("1", "3", 1.0), ("2", "3", 1.0)]))
    assert {r.id: r.in_degree for r in graph.in_degree(e).collect()} == {"1": 1, "2": 1, "3": 2}
    assert sorted(r.cond for r in graph.row_normalised(e).collect()) == [0.5, 0.5, 1.0, 1.0]
    assert activation(graph.spread(e, seeds(spark, ("q", "0", 1.0)), "raw", hops=2, damping=1.0)) == {("q", "3"): 2.0}


def test_components_and_paths(spark):
    e = edges(spark, [(str(i), str(i + 1), 0.5) for i in range(10, 30)] + [("x", "y", 0.9), ("y", "x", 0.9)])
    assert {r.id: r.component for r in graph.components(e).collect()} == {str(i): "10" for i in range(10, 31)} | {"x": "x", "y": "x"}
    paths = graph.simple_paths(e, spark.createDataFrame([("x",)], "id string"), 3, 0.3)
    assert [tuple(r.path) for r in paths.collect()] == [("x", "y")]


def test_codebook_needs_strength(spark):
    e = spark.createDataFrame([("a", "b", 1.0, 0.0, 1.0), ("a", "c", 1.0, 1.0, 1.0)], "src string, dst string, weight double, strength double, match double")
    got = {r.id for r in graph.codebook_spread(e, seeds(spark, ("q", "a", 1.0)), hops=1).collect()}
    assert got == {"a", "c"}


def test_gate_and_decay(spark):
    e = spark.createDataFrame([("a", "b", "r", 0.5), ("a", "c", "r", 0.5), ("d", "d", "r", 0.5)], "src string, dst string, rel string, weight double")
    passes = spark.createDataFrame([("1", ["a", "b", "d"])], "pass_id string, node_ids array<string>")
    spared = evolve.fired(e, passes)
    assert [tuple(r) for r in spared.collect()] == [("a", "b")]
    got = {(r.src, r.dst): r.weight for r in evolve.decayed(e, spared).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): pytest.approx(0.4875), ("d", "d"): pytest.approx(0.4875)}


def test_delta_merge(spark):
    e = spark.createDataFrame([("a", "b", None, 0.9), ("a", "b", "r", 0.2), ("a", "b", "r", 0.4)], "src string, dst string, rel string, weight double")
    d = spark.createDataFrame([("a", "b", None, 0.3), ("a", "b", "r", -5.0), ("x", "y", "r", 0.25), ("x", "y", "r", 0.25)], "src string, dst string, rel string, delta double")
    got = {(r.src, r.dst, r.rel): r.weight for r in evolve.merge_deltas(e, d).collect()}
    assert got == {("a", "b", None): 1.0, ("a", "b", "r"): 0.4, ("x", "y", "r"): 0.5}


def test_saturation_and_firing(spark):
    e = spark.createDataFrame([("a", str(i), "r", w) for i, w in enumerate((0.1, 0.5, 2.0))], "src string, dst string, rel string, weight double")
    assert sorted(r.weight for r in evolve.saturated(e, 2).collect()) == [0.5, 1.0]
    nodes = spark.createDataFrame([("a", 5, 4, None)], "id string, fired_total long, fired_recent long, last_fired timestamp_ntz")
    passes = spark.sql("select timestamp_ntz'2020-01-01 00:00:00' as at, array('a', 'a', 'b') as node_ids")
    r = evolve.firing_fold(nodes, passes).first()
    assert (r.fired_total, r.fired_recent, str(r.last_fired)) == (6, 4, "2020-01-01 00:00:00")


def test_mutations(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, n long, s string")
    new = spark.createDataFrame([("b", None, "y"), ("z", 9, "z")], "id string, n long, s string")
    assert sorted(map(tuple, evolve.update_known(t, new).collect())) == [("a", 1, "x"), ("b", 2, "y")]
    assert sorted(map(tuple, evolve.upsert(t, new).collect()))[1:] == [("b", None, "y"), ("z", 9, "z")]


def test_merge_proposals_and_rewire(spark):
    names = spark.createDataFrame([("1", "n"), ("2", "n"), ("3", "m"), ("2", "m")], "id string, name string")
    nodes = spark.createDataFrame([("1", 5.0), ("2", 1.0), ("3", 9.0)], "id string, potential double")
    pairs = identity.propose_merges(names, nodes)
    assert sorted(map(tuple, pairs.collect())) == [("1", "2", 1), ("3", "2", 1)]
    assert identity.resolve(pairs.withColumn("verdict", F.lit("same"))).count() == 0  # two anchors: ambiguous
    remap = spark.createDataFrame([("2", "1")], "member string, anchor string")
    e = spark.createDataFrame([("2", "1", "r", 0.4), ("1", "3", "r", 0.7), ("2", "3", "r", 0.7), ("4", "4", "r", 0.1)], "src string, dst string, rel string, weight double")
    assert sorted(map(tuple, identity.rewire(e, remap).collect())) == [("1", "3", "r", 1.0), ("4", "4", "r", 0.1)]


def test_mmr_and_seats():
    rel = np.array([0.9, 0.89, 0.5])
    unit = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    assert seeding.mmr_order(rel, unit, 0.5) == [0, 2, 1]
    assert seeding.seats([0, 1, 2, 3], [3, 3, 3, 0], 3) == [0, 1, 3]
    assert seeding.seats([0, 1, 2], [3, 3, 3], 3) == [0, 1, 2]  # the cap on hubs gives way


def test_filtered_rank_averages_ties(spark):
    scores = spark.createDataFrame([(1, i, s) for i, s in enumerate((0.9, 0.5, 0.5, 0.5, 0.1))], "query_id int, id int, score double")
    truth = spark.createDataFrame([(1, 2)], "query_id int, id int")
    known = spark.createDataFrame([(1, 0)], "query_id int, id int")
    assert ranking.filtered_rank(scores, truth, known).first().rank == 2.0


def test_sign_test_and_kappa(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (104, 55)], "b int, w int").select("b", ranking.sign_test("b", "w").alias("p"))
    assert {r.b: r.p for r in df.collect()} == {0: 1.0, 5: pytest.approx(0.0625), 104: pytest.approx(0.000127, rel=0.1)}
    same = spark.createDataFrame([(1, 1)] * 3, "a int, b int")
    assert ranking.kappa(same, "a", "b").first().kappa == 1.0


def test_vectors(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert one(spark, vectors.cosine(arr(3.0, 4.0), arr(3.0, 4.0))) == pytest.approx(1.0)
    assert one(spark, vectors.cosine(arr(), arr())) == 0.0 and one(spark, vectors.cosine(arr(0.0), arr(1.0))) == 0.0
    assert one(spark, vectors.frame_cosine(arr(0.0, 0.0), arr(1.0, 2.0))) == 1.0
    assert one(spark, vectors.l2_normalise(arr(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, vectors.jaccard(arr(), arr())) == 1.0


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalar.freshness_linear(lit(None).cast("double"))) == 1.0 and one(spark, scalar.freshness_linear(lit(15.0))) == 0.5
    assert one(spark, scalar.connectivity_log(lit(0))) == 0.0 and one(spark, scalar.connectivity_log(lit(500))) == 1.0
    assert one(spark, scalar.effective_weight(lit(0.9), lit(0.3))) == 1.0 and one(spark, scalar.effective_weight(lit(0.9), lit(0.3), "invert")) == pytest.approx(0.6)
    assert one(spark, scalar.super_linear_decay(lit(0.5), lit(0))) == pytest.approx(0.4875)
    assert one(spark, scalar.depth_band(lit(1.0), lit(1.0), lit(2))) == 3
    assert 0 <= one(spark, scalar.codebook_id(lit(12))) < 512
    assert one(spark, scalar.scrubbed(lit(float("nan")))) is None


def test_texts(spark):
    s = F.lit
    assert one(spark, text.label_form(s("O'Brien's  Café-12"))) == "o brien caf 12"
    assert one(spark, text.answer_form(s("The  U.S. an apple!"))) == "us apple"
    assert one(spark, text.relation_form(s(" Born In! "))) == "born_in"
    assert one(spark, text.paragraphs(s("one paragraph\n \nshort\r\n\r\nanother paragraph"))) == ["one paragraph", "another paragraph"]
    assert one(spark, text.sentences(s('A b. "C d!" E'))) == ["A b.", '"C d!"', "E"]
    assert one(spark, text.overlapping_chunks(s("abcdefghij"), 4, 2)) == ["abcd", "cdef", "efgh", "ghij"]
    assert one(spark, text.truncated(s("abcdef"), 4)) == "abc…"
    assert [one(spark, text.match_strength(s("Foo Bar"), s(x))) for x in ("Foo Bar", "foo bar", "foobar", "foo-bar", "x")] == [4, 3, 2, 1, 0]
    assert one(spark, text.citations(s("[NODE-0a] b [NODE-1f][NODE-0a]"))) == ["NODE-0a", "NODE-1f"]


def test_line_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("Q1\tone\tuno\nbad-line\n\nQ2\t\nQ3\tthree\n")
    good, bad = text_files.entities(spark, str(tmp_path / "e.txt"))
    assert sorted((r.qid, r.aliases) for r in good.collect()) == [("Q1", ["one", "uno"]), ("Q3", ["three"])]
    assert sorted(r.reason for r in bad.collect()) == ["bad id", "blank", "no alias"]
    (tmp_path / "t.txt").write_text("Q1\tP2\tQ3\nQ1\tP2\nX\tP2\tQ3\n")
    good, bad = text_files.triples(spark, str(tmp_path / "t.txt"))
    assert [tuple(r) for r in good.collect()] == [("Q1", "P2", "Q3")] and bad.count() == 2
    (tmp_path / "x.txt").write_text("Q1\ta\tb c\nQ2\n")
    assert [tuple(r) for r in text_files.texts(spark, str(tmp_path / "x.txt"))[0].collect()] == [("Q1", "a\tb c")]
    (tmp_path / "log.json").write_text(json.dumps({"src": "a", "dst": "b", "rel": "r", "delta": 0.5}) + '\n{"src": "tor')
    assert text_files.delta_log(spark, str(tmp_path / "log.json")).count() == 1


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    for n in range(3):
        assert table.commit(spark.range(n + 1)) == n
    table.commit(table.read(1), 2)  # a batch run again
    assert table.read().count() == 2 and table.prune(1) == [0, 1] and table.versions() == [2]
