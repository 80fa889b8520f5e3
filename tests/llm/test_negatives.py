"""Hard negatives against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomquery.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, c int, leaf string, w int"


def brute(rows):
    good = []
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, vec_id, [int(max(-9.2e18, min(9.2e18, np.floor(256 * float(x))))) for x in v], (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for i, vec_id, v, label in good:
        if vec_id % 50:
            continue
        near = sorted((-max(hn.LEAST, min(hn.MOST, sum(a * b for a, b in zip(v, w)))), d, j, own) for j, d, w, own in good if j != i)
        for p, positive, *_ in [x for x in near if x[3] == label][:5]:
            fits = [(s, d) for s, d, _, own in near if own != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(vec_id, positive, n, d, -p, -s) for n, (s, d) in enumerate(fits[:3], 1)]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(a, b, c, 1, "x", 2) for a, b, c in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(df, F.col("vec_id") % 50 == 0, F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    centres = 3 * rng.normal(size=(12, dims))
    rows = [(int(i), (centres[i % 12] + 0.3 * rng.normal(size=dims)).round(2).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    odd = [(None, [1.0] * dims, 1), (5, None, 1), (6, [1.0] * dims, None), (7, [None] * dims, 1), (8, [float("nan")] * dims, 2), (9, [float("inf")] * dims, 2), (50, [], 1), (100, [1.0], 2), (0, rows[0][1], 1), (0, rows[0][1], 1)]
    return rows + odd + [(1000 + i % 40, rows[3][1], i % 3) for i in range(150)]


@pytest.mark.parametrize("seed,leaf_rows", [(1, 20), (2, 60), (3, 4096)])
def test_against_all_pairs(spark, monkeypatch, seed, leaf_rows):
    monkeypatch.setattr(hn, "FAN_OUT", 4)
    monkeypatch.setattr(hn, "CHUNK", 3)
    rows = clustered(400, seed)
    assert found(spark, rows, leaf_rows=leaf_rows) == sorted(brute(rows))


def test_large_components(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), (rng.normal(size=4) * 10.0 ** rng.integers(0, 22)).tolist(), i % 3) for i in range(120)]
    assert found(spark, rows, leaf_rows=16) == sorted(brute(rows))


def test_nothing(spark):
    assert found(spark, [(None, [1.0], 1)]) == []
    assert found(spark, [(50, [1.0, 2.0], 1)]) == []
    assert found(spark, [(i, [0.0, 0.0], i % 2) for i in range(60)]) == sorted(brute([(i, [0.0, 0.0], i % 2) for i in range(60)]))


def test_tree_leaves_out_siblings():
    """On clustered vectors an annulus meets few leaves, and all that hold one of its vectors are among them."""
    rng = np.random.default_rng(5)
    x = np.concatenate([10 * c + rng.normal(size=(200, 16)) for c in 3 * rng.normal(size=(40, 16))]).round(2)
    x = np.floor(256 * x).astype(np.int64)
    norm = float(np.sqrt((x.astype(float) ** 2).sum(axis=1).max())) * (1 + 1e-9)
    high = hn.raised(x, norm)
    tree = hn.grown(high[rng.permutation(len(x))[:1000]], norm, 64)
    spans = tree.empty_spans()
    leaf = tree.place(high, spans)
    tree.ranges = spans
    assert tree.n_leaves > 30 and leaf.max() < tree.n_leaves
    opened = []
    for q in x[::97]:
        s = x @ q
        for low, most in ((np.sort(s)[-20], np.sort(s)[-10]), (np.sort(s)[-300], np.sort(s)[-250])):
            leaves, _ = tree.open_leaves(q, *tree.annuli(q, np.array([low], float), np.array([most], float)))
            assert set(leaf[(s >= low) & (s <= most)]) <= set(leaves)
            opened.append(len(leaves) / tree.n_leaves)
    assert np.mean(opened) < 0.5, np.mean(opened)
