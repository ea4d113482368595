"""First-generation answers, link prediction and late rows on small graphs."""

import pytest

from arboryx.operators import first_answers, link_prediction, ranking


def test_first_generation_retrieves_assembles_and_answers(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "id string, v array<double>")
    edges = spark.createDataFrame([("a", "b", 1.0, 3.0, 1.0), ("a", "c", 1.0, 0.0, 1.0), ("b", "c", 0.5, 1.0, -1.0)], "src string, dst string, weight double, strength double, match double")
    found = first_answers.retrieve(nodes, edges, spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, v array<double>"), k=2, hops=1)
    got = {r.id: (r.score, r.rank) for r in found.collect()}
    # a keeps a fifth of 1; b gets 0.85 * ln(1 + 3); what has no strength or no match conducts nothing
    assert got["b"] == (1.0, 1) and "c" not in got and set(got) <= {"a", "b"}
    with pytest.raises(ValueError, match="positive"):
        first_answers.retrieve(nodes, edges, nodes, k=0)

    found = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.4, 2), ("r", "c", 0.1, 1)], "query_id string, id string, score double, rank int")
    told = spark.createDataFrame([("a", "A", 0.5, "one\ntwo", "book", "x", "p. 1"), ("b", "B", 0.75, None, "book", "x", None), ("c", "C", 0.1, "", "web", None, None)], "id string, label string, confidence double, description string, source_type string, identifier string, location string")
    links = spark.createDataFrame([("a", "b", "r", 0.2), ("a", "b", "r", 0.3), ("a", "c", "r", 1.0)], "src string, dst string, rel string, weight double")
    made = first_answers.assembled(found, told, links)
    assert [tuple(r) for r in made["edges"].collect()] == [("q", "a", "b", "r", 0.3)]
    assert {tuple(r) for r in made["gaps"].collect()} == {("q", ""), ("r", "no_strong_match")}
    assert {tuple(r) for r in made["sources"].collect()} == {("q", "book", "x", 1), ("r", "web", "", 1)}
    answers = {r.query_id: r for r in first_answers.offline_answer(made["nodes"], spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")).collect()}
    assert answers["q"].cited == ["b", "a"] and answers["q"].text.split("\n")[1:] == ["- [b] B — x (confidence 0.75)", "- [a] A — x (p. 1) (confidence 0.50)", "  one", "  two"]
    assert answers["s"].cited == [] and "unknown source" in answers["r"].text


def test_rankers_by_hand(spark):
    nodes = spark.createDataFrame([(i, [1.0, 0.0] if i < 2 else [0.0, 1.0]) for i in range(5)], "id int, v array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (3, 2, 1.0)], "src int, dst int, weight double")
    pairs, known = spark.createDataFrame([(0, 2)], "head int, tail int"), spark.createDataFrame([(0, 2), (0, 1)], "head int, id int")
    got = {r.ranker: r.mean_rank for r in link_prediction.compared(nodes, edges, pairs, known, hops=2).collect()}
    # candidates are 2, 3 and 4: 2 has the most edges, alone gets activation, and is as far as the others
    assert got["degree"] == 1 and got["sa_raw"] == 1 and got["sa_degnorm"] == 1 and got["knn"] == 2 and 1 <= got["random"] <= 3


def test_holders_of_whole_passages(spark):
    docs = [(1, "so it was, one two three four five six seven eight and on"), (2, "one two three four five six"), (3, "a xyz b"), (4, None), (5, "oneone two three four five six seven eightfold")]
    passages = [("a", "one two three four five six seven eight"), ("b", "xyz"), ("c", ""), ("d", "one two three"), ("e", "two thr")]
    got = {tuple(r) for r in ranking.holders(spark.createDataFrame(passages, "query_id string, text string"), spark.createDataFrame(docs, "id int, text string")).collect()}
    assert got == {(q, i) for q, p in passages for i, t in docs if p and t and p in t}


@pytest.mark.parametrize("a,b", [(["x", "x", "y"], ["x", "y", "y"]), ([], []), ([], ["a"]), (["b", "a", "b"], ["b", "b", "b"])])
def test_token_f1(spark, a, b):
    from collections import Counter

    from pyspark.sql import functions as F

    want = float(a == b) if not a or not b else 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))
    got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(ranking.token_f1(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(want)


def test_short_texts_find_labels(spark):
    from arboryx.operators import lookup

    nodes = spark.createDataFrame([("1", "ab c"), ("2", "xAb"), ("3", "b"), ("4", "")], "id string, label string")
    asked = spark.createDataFrame([(1, "ab"), (2, "B"), (3, "c"), (4, ""), (5, "ab c"), (6, "4")], "query_id int, text string")
    got = {}
    for r in lookup.search(nodes, asked).collect():
        got.setdefault(r.query_id, set()).add((r.id, r.tier))
    assert got == {1: {("1", 1), ("2", 1)}, 2: {("1", 1), ("2", 1), ("3", 1)}, 3: {("1", 1)}, 5: {("1", 1)}, 6: {("4", 0)}}
