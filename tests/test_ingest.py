"""Descriptions that accrue against a loop over mentions; consolidation commits whole or not at all."""

import random
import re

import pytest
from pyspark.sql import functions as F

from arboryx.operators import consolidate, ingest
from arboryx.sources.versions import VersionSet


def bare(x):
    x = re.sub(r"\s+", " ", x.lower()).strip(" ")
    x = re.sub("^[\"“”‘’']+|[\"“”‘’']+$", "", x)
    return re.sub("^[\"“”‘’' ]+|[\"“”‘’' ]+$", "", re.sub("[.!?…]+$", "", x))


def sentences(x):
    return [re.sub(r"\s+", " ", s).strip() for s in re.sub("([.!?][\"')\\]]*)\\s+", "\\1\u0001", x).split("\u0001") if s.strip()]


def grow(standing, body, most):
    said, full = standing, False
    for s in sentences(body):
        key = bare(s)
        if full or not key or re.search(rf"(?<!\w){re.escape(key)}(?!\w)", bare(said)):
            continue
        longer = s if not said else said + (" " if re.search("[.!?…,;:][\"”’')\\]]*$", said) else ". ") + s
        if len(longer) > most:
            full = True
        else:
            said = longer
    return said


@pytest.mark.parametrize("at_once,most", [(64, 500), (2, 90), (1, 40)])
def test_descriptions_accrue_in_order(spark, at_once, most):
    rng = random.Random(at_once)
    parts = ["King of gods.", "king of  gods!", "Son of Cronos.", '"A god."', "Holds the a\\Eb+ (aegis)", "é été", "Father", "?!", "x" * 35 + ".", "Son", "gods"]
    nodes = [(i, rng.choice(["Zeus", "Zeus — king of gods.", None, ""])) for i in range(6)]
    mentions = [(rng.choice([0, 0, 0, 1, 2, 3, 9]), k, f"s{k % 7}", rng.choice([None, "", " ".join(rng.choices(parts, k=rng.randrange(1, 4)))])) for k in range(120)]
    got = ingest.accrued(spark.createDataFrame(nodes, "id int, description string"), spark.createDataFrame(mentions, "id int, ord int, source string, body string").repartition(4), most, at_once)
    for r in got.collect():
        said, sources = (dict(nodes)[r.id] or "").strip(), []
        for _, _, source, body in (m for m in mentions if m[0] == r.id and m[3] is not None):
            longer = grow(said, body, most)
            if longer != said:
                said = longer
                sources.append(source)
        assert (r.description, r.revisions, r.sources) == (said, len(sources), sources)
    assert got.count() == 6


def test_remaps_follow_chains_and_leave_circles(spark):
    rows = [(i, i - 1) for i in range(1, 20)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 200 + 1)]
    got = {r.member: r.anchor for r in consolidate.followed(spark.createDataFrame(rows, "member int, anchor int")).collect()}
    assert got == {**{i: 0 for i in range(1, 20)}, 200: 201}
    assert consolidate.followed(spark.createDataFrame([], "member int, anchor int")).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    nodes = "id long, description string, born int, last_fired int, fired_total long, tags array<string>, candidate boolean"
    edges = "src long, dst long, rel string, weight double, born int, last_fired int"
    s = VersionSet(spark, str(tmp_path / "mesh"))
    s.commit({
        "nodes": spark.createDataFrame([(1, "Zeus", 5, 6, 2, ["a"], True), (2, "her father", 3, 9, 4, ["b", "a"], True), (3, "x", 1, 1, 1, [], True)], nodes),
        "edges": spark.createDataFrame([(2, 3, "r", 0.7, 2, 4), (1, 3, "r", 0.6, 3, 3), (2, 1, "same", 0.5, 1, 1), (3, 3, "loop", 0.1, 1, 1), (3, 2, "r", 0.2, 1, 1)], edges),
        "deltas": spark.createDataFrame([(2, 3, "r", 0.1), (1, 2, "r", 0.1)], "src long, dst long, rel string, delta double"),
    })
    return s


def test_consolidation_is_one_commit(spark, store):
    verdicts = spark.createDataFrame([(2, 1, "same"), (3, 1, "different"), (9, 1, "same"), (3, 9, "same")], "member long, anchor long, verdict string")
    assert consolidate.consolidate(store, verdicts) == 1
    assert {tuple(r) for r in store.read("edges").collect()} == {(1, 3, "r", 1.0, 2, 4), (3, 3, "loop", 0.1, 1, 1), (3, 1, "r", 0.2, 1, 1)}
    zeus = store.read("nodes").where("id = 1").first()
    assert (zeus.born, zeus.last_fired, zeus.fired_total, zeus.tags, zeus.candidate) == (3, 9, 6, ["a", "b"], False)
    assert [tuple(r) for r in store.read("deltas").collect()] == [(1, 3, "r", 0.1)]
    assert [tuple(r) for r in store.read("absorbed").collect()] == [(2, 1)] and store.read("nodes", 0).count() == 3


def test_a_failed_commit_leaves_the_old_version(spark, store):
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"nodes": store.read("nodes").limit(1), "edges": bad})
    assert store.versions() == [0] and store.read("nodes").count() == 3
    assert store.commit({"nodes": store.read("nodes").limit(1)}) == 2 and store.versions() == [0, 2]
    assert store.prune(1) == [0, 1] and store.versions() == [2] and store.read("nodes").count() == 1


def test_two_writers_take_two_numbers(spark, store):
    other = VersionSet(spark, store.path)
    seen = other._numbers

    def stale(folder):  # the other writer listed before this one claimed its number
        return [n for n in seen(folder) if n < 1]

    assert store.commit({"nodes": store.read("nodes")}) == 1
    other._numbers = stale
    assert other.commit({"nodes": store.read("nodes").limit(2)}) == 2
    assert store.versions() == [0, 1, 2] and store.read("nodes").count() == 2 and store.read("nodes", 1).count() == 3
