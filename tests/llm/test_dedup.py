"""Exact dedup, SimHash groups and the pipeline's filters against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomquery.llm import golay
from loomquery.llm.exact_dedup import drop_copies, exact_dedup
from loomquery.llm.simhash import fingerprint, links, near_dedup, stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)


AWKWARD = [(1, None), (2, ""), (3, "Abc É"), (4, "aBC É"), (5, "abc é"), (None, "abc É"), (6, "x " * 30_000), (7, "X " * 30_000), (8, "solo"), (8, "solo"), (None, None)]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(A_Z), []).append(i)
    out = []
    for i, t in rows:
        key = (t or "").translate(A_Z)
        ids = [x for x in groups[key] if x is not None]
        out.append((i, max(ids) if ids else None, len(groups[key]), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup_equals_brute_force(spark, fan_in):
    rng = random.Random(3)
    rows = AWKWARD + [(100 + i, rng.choice(["a", "B", "b", "c d", "C D"])) for i in range(300)]
    found = exact_dedup(docs(spark, rows).repartition(7), fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == brute_exact(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})  # one row each, repeated rows included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_smallest_empty_and_clashing_columns(spark):
    few = docs(spark, [(1, "a"), (2, "A")]).withColumn("digest", F.lit(1)).withColumn("run", F.lit(2)).withColumn("best", F.lit(3))
    assert {r.keep_id for r in exact_dedup(few, keep="smallest").collect()} == {1}
    assert exact_dedup(docs(spark, [])).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    table = docs(spark, AWKWARD).withColumn("copies", F.lit(1)).withColumn("key", F.lit(2)).withColumn("mark", F.lit(3))
    left = drop_copies(table)
    assert left.columns == table.columns
    assert sorted(((r.text or "").translate(A_Z) for r in left.collect())) == sorted({(t or "").translate(A_Z) for _, t in AWKWARD})


def test_golay_code_is_perfect():
    words = np.arange(1 << 12, dtype=np.int64) * 2039 % (1 << 23)
    leader = golay.patterns(0)[golay.syndromes(words)]
    assert leader.shape[1] == 1 and (golay.syndromes(words ^ leader[:, 0]) == 0).all()
    assert (np.bitwise_count(leader) <= 3).all()


def plain_fingerprint(text):
    words = [w for w in (text or "").translate(A_Z).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    span = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + span]).encode(), 42) for i in range(len(words) - span + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one Two", "a b c", "a b c d É e f g", "w " * 500, " ".join(map(str, range(900)))])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_a_text_longer_than_a_block():
    text = " ".join(map(str, range(70_000)))
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_links_lose_nothing(spark, blocks):
    rng = random.Random(blocks)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for flips in (0, 1, 2, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), flips):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    want = {tuple(sorted(p)) for p in itertools.combinations(fps, 2) if ((p[0] ^ p[1]) & (1 << 64) - 1).bit_count() <= 2}
    got = [(r.u, r.v) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long"), blocks=blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_stars_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [tuple(sorted(rng.sample(range(100, 400), 2))) for _ in range(150)]
    parent = list(range(401))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r.node: r.root for r in stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for e in edges for x in e if find(x) != x}
    assert stars(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_groups(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, "other words here"), (None, "other words here"), (7, "z"), (7, "z")]
    found = {(r.doc_id, r.component_id) for r in near_dedup(docs(spark, rows).withColumn("fp", F.lit(1)).withColumn("root", F.lit(1))).collect()}
    fps = {i: plain_fingerprint(t) for i, t in rows}
    expected_tail = 1 if (fps[1] ^ fps[3]).bit_count() <= 2 else 3
    assert found == {(1, 1), (2, 1), (3, expected_tail), (4, 4), (5, 4), (6, 6), (None, 6), (7, 7)}
    assert near_dedup(docs(spark, [])).count() == 0
