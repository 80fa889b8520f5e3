"""The conversation trie against a trie built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomquery.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, x1 int, conv string"


def brute(rows, shared_from, shared):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {c: own.get(shared_from(c), [])[: shared(c)] + v[shared(c) :] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in sorted(built.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[p] for p in children[path]]
        leaves = sum(b[0] for b in below) if below else 1
        saved = sum(b[1] for b in below) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        sums[path] = leaves, saved
        out.append((members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(children[path]), leaves, saved, hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()))
    return out


def base(c):
    return c - c % 100 if c >= 0 else c + -c % 100


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(300, 330), -5, -100, -130, 205]:
        for turn in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["", None, "a", "bé", "long text"])))
    for c in range(400, 420):  # alike from the first turn to the last
        rows += [(c, t, "user", "same") for t in range(7)]
    rows += [(7, 1, "user", "again")] * 3 + [(None, 1, "user", "nobody's")] * 2
    rows += [(c, t, "u", f"{t % 3}{'x' * (c == 502 and t == 60)}") for c in (500, 501, 502) for t in range(90)]
    return rows


@pytest.mark.parametrize("seed,height,stretch", [(1, 2, 1 << 16), (2, 3, 7), (3, 16, 20), (4, 200, 1 << 16)])
def test_trie(spark, monkeypatch, seed, height, stretch):
    monkeypatch.setattr(pt, "STRETCH", stretch)
    monkeypatch.setattr(pt, "HOT", 2)
    monkeypatch.setattr(pt, "CHUNK", 3)
    rows = made(seed)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(6)
    conv = F.col("conv")
    found = pt.prefix_trie(df, conv - conv % 100, F.crc32(conv.cast("string")) % 6, height=height)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    expected = brute(rows, base, lambda c: zlib.crc32(str(c).encode()) % 6)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_hot_end(spark):
    """All conversations end at one node: its identifiers meet as strings."""
    rows = [(c, 1, "user", "hello") for c in range(25_000)]
    found = pt.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), F.col("conv"), F.lit(0))
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, lambda c: c, lambda c: 0), key=lambda r: r[:2])


def test_nothing(spark):
    df = spark.createDataFrame([(None, 1, "user", "x", "", 1, "")], SCHEMA)
    assert pt.prefix_trie(df, F.col("conv"), F.lit(0)).collect() == []
    assert pt.prefix_trie(df.limit(0), F.col("conv"), F.lit(0)).collect() == []
