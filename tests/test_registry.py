"""Linking in rounds against a loop that links one mention after the other."""

import random

import numpy as np
import pytest

from arboryx.operators import registry


def by_loop(mentions, nodes):
    first, knows, vector, out = {}, {}, {}, {}

    def learn(node, since, label, external):
        for key in [*("q:" + q for q in external or []), *(["l:" + label] if label else [])]:
            first.setdefault(key, node)
            knows.setdefault(key, {}).setdefault(node, since)

    for node, label, external, v in sorted(nodes, key=lambda n: n[0]):
        vector[node] = v
        learn(node, -1, label or "", external)
    for o, label, external, v in sorted(mentions, key=lambda m: m[0]):
        label, choice, score = label or "", None, 0.0
        for q in external or []:
            if choice is None and "q:" + q in first:
                choice, signal, score = first["q:" + q], "external", 1.0
        if choice is None and v is not None and label:
            found = []
            for node, since in knows.get("l:" + label, {}).items():
                w = vector[node]
                if w is not None:
                    cosine = np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) if np.linalg.norm(v) * np.linalg.norm(w) > 0 else 0.0
                    if round(cosine + 0.05, 9) >= 0.72:
                        found.append((round(cosine + 0.05, 9), -since, node))
            if found:
                score, _, choice = max(found)
                signal = "description"
        if choice is None and "l:" + label in first and label:
            choice, signal = first["l:" + label], "name"
        if choice is None:
            choice, signal = f"m{o}", "new"
            vector[choice] = v
        learn(choice, o, label, external)
        out[o] = (choice, signal, score)
    return out


@pytest.mark.parametrize("seed,with_nodes", [(1, False), (2, True)])
def test_links_are_those_of_a_loop(spark, seed, with_nodes):
    rng = random.Random(seed)
    names, ids = ["zeus", "hera", "cronos", "rhea", "", None], ["Q1", "Q2", "Q3", "Q4", "Q5"]
    vec = lambda: rng.choice([None, [1.0, 0.0], [0.9, 0.3], [0.0, 1.0], [-1.0, 0.2], [0.0, 0.0]])
    mentions = [(o, rng.choice(names), rng.choice([None, [], rng.sample(ids, 1), rng.sample(ids, 2)]) if rng.random() < 0.5 else None, vec()) for o in rng.sample(range(500), 70)]
    nodes = [("a", "zeus", ["Q4"], [1.0, 0.0]), ("b", "zeus", ["Q4", "Q5"], [0.0, 1.0]), ("c", None, None, None)] if with_nodes else []
    df = spark.createDataFrame(mentions, "ord long, label string, external array<string>, v array<double>").repartition(3)
    known = spark.createDataFrame(nodes, "node string, label string, external array<string>, v array<double>") if with_nodes else None
    got = {r.ord: (r.node, r.signal, pytest.approx(r.score)) for r in registry.link_in_order(df, known).collect()}
    want = by_loop(mentions, nodes)
    assert got == want and {s for _, s, _ in want.values()} == {"external", "description", "name", "new"}


def test_no_mentions(spark):
    assert registry.link_in_order(spark.createDataFrame([], "ord long, label string, external array<string>, v array<double>")).count() == 0
