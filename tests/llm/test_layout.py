"""Sharding, packing, top-k search, licenses, the pipeline and the queries' SQL."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from loomquery.llm.licenses import license_scan
from loomquery.llm.packing import best_fit, pack
from loomquery.llm.sharding import interleave_shards
from loomquery.llm.topk import Lists, top_k
from tests.oracle import differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("buckets", [1, 64])
def test_shards_hold_the_mixture(spark, buckets):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 50), "hot" if i % 3 else rng.choice(["a", "b", None])) for i in range(700)] + [(None, None, "a"), (5, "dup", "b"), (5, "dup", "b")]
    table = docs(spark, rows).withColumn("shard", F.lit(1)).withColumn("part", F.lit(1))
    found = interleave_shards(table, shards=8, buckets=buckets).collect()
    assert len(found) == len(rows)
    assert sorted((r.size, r.text_crc32) for r in found) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    source = {i: s for i, _, s in rows}
    hot = collections.Counter(r.shard for r in found if source.get(r.doc_id) == "hot")
    share = sum(hot.values()) / 8
    assert all(abs(n - share) <= 2 for n in hot.values())


def test_shards_do_not_depend_on_buckets(spark):
    table = docs(spark, [(i, str(i), f"s{i % 4}") for i in range(200)])
    a, b = ({(r.doc_id, r.shard, r.slot) for r in interleave_shards(table, buckets=n).collect()} for n in (1, 99))
    assert a == b
    assert interleave_shards(docs(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    assert best_fit([6, 5, 4, 3], [0, 1, 2, 3], [-1] * 4, 10, 9) == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert best_fit([6, 5, 4], [0, 1, 2], [7, -1, 7], 10, 9)[2][0] == 1  # the tightest bin holds a copy
    assert best_fit([6, 4], [0, 0], [-1, -1], 10, 1)[1][0] == 1  # the source has had its share


def test_best_fit_equals_a_naive_search():
    rng = random.Random(12)
    for _ in range(30):
        n, capacity, per_source = 120, 40, rng.randint(1, 4)
        sizes = sorted((rng.randint(1, capacity) for _ in range(n)), reverse=True)
        sources, clusters = [rng.randrange(5) for _ in range(n)], [rng.randrange(-1, 9) for _ in range(n)]
        bins, want = [], []
        for size, source, cluster in zip(sizes, sources, clusters):
            fits = [
                (capacity - sum(s for s, _, _ in held), i)
                for i, held in enumerate(bins)
                if capacity - sum(s for s, _, _ in held) >= size and sum(o == source for _, o, _ in held) < per_source and (cluster < 0 or all(c != cluster for _, _, c in held))
            ]
            at = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([])
            want.append((at, sum(s for s, _, _ in bins[at])))
            bins[at].append((size, source, cluster))
        assert best_fit(sizes, sources, clusters, capacity, per_source) == want


def test_packing_law(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(rng.randint(0, 60))) if i % 5 else "same text here", f"s{i % 3}") for i in range(400)]
    rows += [(None, None, None), (1000, "long " * 250, "s0"), (2000, "again", "s1"), (2000, "again", "s1")]
    found = pack(docs(spark, rows).withColumn("block", F.lit(1)).withColumn("bin", F.lit(1)), capacity=64, per_source=2, block_rows=100).collect()
    assert len(found) == len(rows)
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    bins = collections.defaultdict(list)
    for r in found:
        assert r.size == len((text[r.doc_id] or "").split()) + 1
        bins[r.bin_id].append(r)
        assert r.full_bins == (r.size - 1) // 64
    for inside in bins.values():
        last = [(r.bin_offset, (r.size - 1) % 64 + 1) for r in inside]
        end = 0
        for at, size in sorted(last):
            assert at == end
            end += size
        assert end <= 64 and all(r.bin_fill == end for r in inside)
        assert all(n == 1 for n in collections.Counter((text[r.doc_id] or "").lower() for r in inside).values())
        assert all(n <= 2 for n in collections.Counter(source[r.doc_id] for r in inside).values())
    assert pack(docs(spark, [])).count() == 0


def test_no_random_access_keeps_every_winner():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-9, 9, (500, 8)).astype(float), rng.integers(-9, 9, (20, 8)).astype(float)
    q[0] = 0
    lists = Lists(x)
    for y in q:
        rows, entries = lists.search(y, np.array([0]), 5)
        score = x @ y
        score[0] = -np.inf
        assert set(np.flatnonzero(score >= np.sort(score)[-5])) <= set(rows) and 0 not in rows and entries <= x.size


def test_reading_stops_early():
    rng = np.random.default_rng(6)
    x = rng.integers(-50, 50, (4000, 16)).astype(float)
    x[:20] += 2000
    lists = Lists(x)
    rows, entries = lists.search(np.ones(16), np.array([3]), 10)
    assert entries < x.size / 10 and 10 <= len(rows) <= 40
    # a query with one heavy component reads hardly anything of the light lists
    y = np.ones(16)
    y[5] = 10_000
    rows, entries = lists.search(y, np.array([3]), 10)
    score = x @ y
    score[3] = -np.inf
    assert set(np.argsort(-score)[:10]) <= set(rows) and entries < x.size / 10
    assert lists.search(y, np.array([3]), 10, bar=1e12)[0].size == 0


@pytest.mark.parametrize("block", [4096, 37])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(200, None), (300, [1.0, None]), (400, [float("nan")] * 6), (500, [float("inf")] * 6), (None, [1.0] * 6), (600, []), (151, rows[7][1]), (7, rows[7][1]), (700, [3.0] * 9), (0, rows[0][1]), (800, [0.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1)).withColumn("c", F.lit(1))
    found = top_k(table, F.col("vec_id") % 100 == 0, k=4, candidate_block=block, query_block=block, reads=True).collect()
    good = [(i, np.floor(1024 * np.array(v + [0.0] * (9 - len(v)))).astype(int)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for a, (i, v) in enumerate(good):
        if i % 100 == 0:
            ranked = sorted((-int(v @ w), j) for b, (j, w) in enumerate(good) if a != b)[:4]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(ranked)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)
    assert all((r.entries is not None) == (r.rank == 1) for r in found)
    assert top_k(table.limit(0), F.lit(True)).count() == 0 and top_k(table, F.lit(False)).count() == 0


def test_top_k_leaves_blocks_out(spark):
    rng = np.random.default_rng(9)
    centres = np.eye(8) * 5
    rows = [(i, (centres[i % 8] + rng.normal(size=8) * 0.1).tolist()) for i in range(1600)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(table, F.col("vec_id") % 100 == 0, candidate_block=100, reads=True)
    x = np.floor(1024 * np.array([v for _, v in rows]))
    assert found.agg(F.sum("entries")).first()[0] < 16 * x.size / 4
    for r in found.filter("rank = 10").collect():
        score = x @ x[r.query_id]
        score[r.query_id] = -np.inf
        assert r.score == np.sort(score)[-10]


def test_top_k_finds_the_place_of_a_vector_once(spark, monkeypatch):
    from loomquery.llm import topk

    steps = {}
    cut = topk.cut
    monkeypatch.setattr(topk, "cut", lambda df, label: steps.setdefault(label, cut(df, label)))
    rows = [(0, [0.0, -3.0]), (1, [2.0, 2.0]), (2, []), (3, [0.0, 0.0])]
    top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1).collect()
    # By the largest component's number (of equal ones the first), its sign and its size.
    assert {r.vec_id: r.place for r in steps["topk-vectors"].collect()} == {0: 5.75, 1: 2 + 2 / 3, 2: 0.0, 3: 2.0}


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, -1.0]), (2, [-1e18, 0.5]), (3, [2.0, 2.0])]
    got = {r.vec_id: r.score for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63), 3: 2**63 - 1}


def test_licenses(spark):
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, filler + " Released under the MIT License. " + filler, "s"),
        (2, "licensed UNDER the apache license, version 2.0", "s"),
        (3, "This work is licensed under the GNU General Public License, version 2.", "s"),
        (4, None, None), (5, "", "s"), (6, "Released under the MIT", "s"),
        (7, "Licensed under CC BY-NC 4.0. " * 400, "s"),
        (8, filler, "s"), (1, "Released under the MIT License.", "s"),
    ]
    found = {}
    for r in license_scan(docs(spark, rows).withColumn("h", F.lit(1)).withColumn("window", F.lit(1))).collect():
        found.setdefault((r.doc_id, r.license_id), []).append(r)
    assert {k: len(v) for k, v in found.items()} == {(1, "MIT"): 2, (2, "Apache-2.0"): 1, (3, "GPL-3.0"): 1, (7, "CC-BY-NC-4.0"): 1}
    assert found[3, "GPL-3.0"][0].containment == 7 / 8
    assert license_scan(docs(spark, [])).count() == 0
    own = spark.createDataFrame([("X", "one two three four five six"), ("Y", "too short")], "license_id string, text string")
    assert [r.license_id for r in license_scan(docs(spark, [(1, "zero one two three four five six", "s")]), own).collect()] == ["X"]
    # a template that repeats its shingles is looked for at its whole length
    again = spark.createDataFrame([("R", "a b c d e " * 6 + "end of it all now")], "license_id string, text string")
    assert [r.containment for r in license_scan(docs(spark, [(1, filler + " " + "a b c d e " * 6 + "end of it all now", "s")]), again).collect()] == [1.0]


def test_licenses_in_parts(spark, monkeypatch):
    import loomquery.llm.licenses as module

    rows = [(1, "Released under the MIT License. Licensed under CC BY-NC 4.0.", "s"), (2, "licensed UNDER the apache license, version 2.0", "s"), (2, "licensed UNDER the apache license, version 2.0", None)]
    whole = sorted(map(tuple, license_scan(docs(spark, rows)).collect()))
    monkeypatch.setattr(module, "MAX_SHINGLES", 30)
    assert sorted(map(tuple, license_scan(docs(spark, rows)).collect())) == whole and len(whole) == 4


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(300))
    rows = [(1, None, "s"), (2, "", "s"), (3, "123", "s"), (4, text, "s"), (5, text.upper(), "s"), (6, text + " tail", "s"), (7, text, None), (7, text, None), (None, "quite another text", "s"), (8, "different words altogether " * 3000, "s")]
    here = docs(spark, rows).withColumn("copies", F.lit(1)).withColumn("root", F.lit(2))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current = here
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == here.columns, name
    left = current.collect()
    assert not {1, 2, 3} & {r.doc_id for r in left}
    assert len([r for r in left if r.text.lower().startswith(text)]) == 1 and {None, 8} <= {r.doc_id for r in left}
    assert corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).count() == len(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, here.limit(0), str(tmp_path)).count() == 0


CORPUS = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]


@pytest.mark.parametrize("name", [n for n in CORPUS if n in __spark_entry__.oracle_sql()])
def test_queries_equal_their_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name) is None


@pytest.mark.parametrize("name", [n for n in CORPUS if n not in __spark_entry__.oracle_sql()])
def test_queries_without_sql_run(spark, name):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
