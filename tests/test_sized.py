"""Findings at size: what differed, or grew faster than its input."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from loomquery.operators import explain, graph, postings, retrieval, scopes
from loomquery.plans import catalog, contextual
from tests.conftest import DATA
from tests.oracle import differences


def test_long_keys_have_no_line_breaks(spark, tmp_path):
    """Spark breaks base64 after 76 characters."""
    urls = [(1, "https://example.com/" + "a" * 200), (2, "é" * 60), (3, ""), (4, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = catalog.QUERIES["key_codec"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.decoded for r in rows} == dict(urls) and all("\n" not in (r.key or "") and "\r" not in (r.key or "") for r in rows)


def _events(spark, folder):
    """Pauses within a second of half an hour, on both sides."""
    start = dt.datetime(2024, 1, 30, 23, 0, 0)
    times, at = [], start
    for user, pause in enumerate([1799.6, 1800.0, 1800.000001, 1800.4, 1800.6, 1801.2]):
        for first in (0.0, 0.3, 0.5, 0.7):
            at = start + dt.timedelta(seconds=first)
            times += [(10 * user + int(10 * first), at), (10 * user + int(10 * first), at + dt.timedelta(seconds=pause))]
    rows = [(i, t, u, "click", 1.0, '{"k": 1}') for i, (u, t) in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    for t in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        duckdb.sql(f"COPY (SELECT * FROM '{DATA}/{t}.parquet' LIMIT 0) TO '{folder}/{t}.parquet' (FORMAT parquet)")


def test_pauses_count_to_the_microsecond(spark, tmp_path):
    """F8, F9: seconds were cut on one side and rounded on the other."""
    _events(spark, tmp_path)
    found = {}
    for r in catalog.QUERIES["sessions_30m"](spark, str(tmp_path)).collect():
        found[r.user_id] = max(found.get(r.user_id, 0), r.session)
    assert found == {10 * user + first: 1 if user < 2 else 2 for user in range(6) for first in (0, 3, 5, 7)}
    assert differences(spark, str(tmp_path), "sessions_30m") is None
    assert differences(spark, str(tmp_path), "session_statistics") is None


def _broadcasts(frame):
    """Broadcasts of a plan, before and after its run."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_scopes_are_not_broadcast(spark):
    """a file's size made Spark broadcast all stretches of all scopes."""
    pages = spark.createDataFrame([(i, "<html><ul><li><a>x</a></li></ul></html>") for i in range(20)], "id long, html string")
    found = scopes.marks(pages, "id", "html")
    ranges = scopes.scopes(found, ["html", "ul", "li"])
    inner = scopes.innermost(found.filter("name = 'a'").select("key", "at"), ranges)
    assert _broadcasts(inner) == 0 and {r.inner["name"] for r in inner.collect()} == {"li"}


def test_index_and_batch_make_no_row_for_a_posting(spark, tmp_path, monkeypatch):
    """every posting was a row of a shuffle, three times in building and once for each query that met it."""
    kept, plans = postings.stored, {}

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, label)

    monkeypatch.setattr(postings, "stored", seen)
    monkeypatch.setattr(postings, "LITERAL_TERMS", 2)
    monkeypatch.setattr(postings, "BLOCK_DOCS", 20)
    monkeypatch.setattr(postings, "GROUP_QUERIES", 3)
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choices("abcdefghij", k=rng.choice([1, 4, 30])))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    queries = docs.filter("doc_id % 20 = 0").selectExpr("doc_id as query_id", "text")
    index = postings.refresh(spark, f"file://{tmp_path}/index", docs)
    found = postings.bm25_top_k(index, queries, 4)
    best = retrieval.top_per_query(retrieval.bm25(docs, queries), 4, F.round("score", 9).desc(), F.col("id"))
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in found.collect()) == sorted((r.query_id, r["rank"], r.id, round(r.score, 8)) for r in best.collect())
    assert "FlatMapCoGroupsInPandas" in plans["index-first"]
    assert "arrays_zip" not in plans["index-first"]


def test_levels_of_chains_belong_to_their_ends(spark, monkeypatch):
    """each pair had levels of its own, although pairs share their goals, and all of them were broadcast by their files' size."""
    kept, sizes = graph.stored, {}

    def seen(df, label):
        out = kept(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(graph, "stored", seen)
    edges = [(f"a{i}", f"b{i}") for i in range(30)] + [(f"b{i}", f"c{j}") for i in range(30) for j in range(20)] + [(f"c{j}", f"d{j}") for j in range(20)] + [(f"d{j}", "z") for j in range(20)]
    frame = spark.createDataFrame(edges, "src string, dst string")
    pairs = spark.createDataFrame([(f"a{i}", "z") for i in range(30)], "src string, dst string")
    for most in (1_000, 5):  # few rows are broadcast, more are shuffled
        monkeypatch.setattr(graph, "SMALL_FRONTIER", most)
        found = {r.src: r.path for r in graph.call_chains(frame, pairs).collect()}
        assert found == {f"a{i}": [f"a{i}", f"b{i}", "c0", "d0", "z"] for i in range(30)}
    assert sizes["chain-frontier"] < 200


def test_contextual_ranking_shuffles_no_words(spark):
    """F15 to F17: all words of every text went through four joins, and all patterns were matched for three."""
    found = contextual.contextual(spark, DATA)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Relation") if "Relation" in plan else len(plan)]
    assert "worded#" in joined and "Singleton" not in plan
    assert explain.counted(["strategy", "wrapper"]) == ["decorator", "state", "strategy", "template", "visitor", "wrapper"]


def test_second_steps_are_packed(spark):
    """F6 of round 4: lists of second steps were shuffled as eight bytes a step, and edges were shuffled five times."""
    big = 2**62
    edges = [(o, 10_000 + o * 7 % 50) for o in range(300)] + [(o, 10_000 + o % 50) for o in range(300)] + [(10_000 + p, big + (p * s * s) % 4000) for p in range(50) for s in range(30)] + [(3, -big), (-big, 10_001), (5, big + 1), (0, 0)]
    want = {(a, d) for a, b in edges for c, d in edges if b == c and a != d} - set(edges)
    frame = spark.createDataFrame(edges * 2, "src long, dst long").repartition(5)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in (size, "3"):  # nodes go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for few in (4096, 20, 1):
                found = [tuple(r) for r in graph.indirect(frame, few).collect()]
                assert len(found) == len(set(found)) and set(found) == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    plan = graph.indirect(frame)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "next#" in plan and "array<" not in plan
