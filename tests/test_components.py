"""Cycles of any length, strongly connected components, and shortest paths node by node."""

import itertools
import random

import pytest

from loomquery.operators import graph
from loomquery.plans import catalog
from tests.conftest import DATA


@pytest.mark.parametrize("small_rest", [0, 100_000])
def test_strong_components(spark, small_rest):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 4), (5, 7), (9, 8), (8, 9), (7, 7), (0, 9), (None, 1)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in graph.strong_components(frame, small_rest).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}


def test_components_of_long_paths_and_random_graphs(spark):
    path = spark.range(199).selectExpr("id as src", "id + 1 as dst")
    assert {r.node: r.component for r in graph.strong_components(path).collect()} == {i: i for i in range(200)}
    rng = random.Random(3)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    reach = {n: {n} for n in range(60)}
    for _ in range(60):
        for a, b in edges:
            reach[a] |= reach[b]
    nodes = {n for e in edges for n in e}
    want = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    found = graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert {r.node: r.component for r in found.collect()} == want


def test_longer_cycles_are_listed(spark):
    found = catalog.QUERIES["cycles_all"](spark, DATA).groupBy("nodes").count().collect()
    assert {r["nodes"]: r["count"] for r in found} == {2: 10, 3: 20, 4: 30, 5: 24}


def test_call_chains(spark):
    rng = random.Random(4)
    edges = sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)}) + [(f"z{i}", f"z{i + 1}") for i in range(6)] + [(None, "n1"), ("z0", "z1")]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def shortest(a, b):
        layer = [[a]]
        for _ in range(7):
            hits = [p for p in layer if p[-1] == b]
            if hits:
                return min(hits)
            layer = [p + [n] for p in layer for n in after.get(p[-1], ()) if n not in p]
        return None

    names = sorted({n for e in edges for n in e if n})
    pairs = [*itertools.islice(((a, b) for a in names for b in names if rng.random() < 0.1), 60), ("z0", "z6"), ("z6", "z0"), ("n1", "n1"), ("nowhere", "n1"), (None, "n1"), ("z0", "z6")]
    want = {(a, b): p for a, b in set(pairs) if a is not None and (p := shortest(a, b)) is not None and len(p) <= 7}
    found = graph.call_chains(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), most=6)
    got = {(r.src, r.dst): r.path for r in found.collect()}
    assert got == want and all(r.steps == len(r.path) - 1 for r in found.collect())
