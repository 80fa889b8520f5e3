"""Vector store, rules as a table, and statistics that no single task holds."""

import random
import statistics

from pyspark.sql import functions as F

from loomquery.operators import advice, analytics, joins
from loomquery.sources import tables
from loomquery.sources.vectors import VectorStore, digest


def test_vector_store(spark, tmp_path):
    kept = VectorStore(spark, f"file://{tmp_path}/v", 4)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "  "), (6, "c"), (7, "d")], "id long, text string")
    asked = kept.requests(docs, "id", F.col("text"))
    assert {r.key: r.state for r in kept.looked_up(asked, "2024-03-01", 30).collect()} == {1: "missing", 2: "missing", 3: "missing", 4: "blank", 5: "blank", 6: "missing", 7: "missing"}

    def put(texts, day):
        kept.put(spark.createDataFrame([(t, [float(i)]) for i, t in enumerate(texts)] + [(None, [9.0])], "t string, vector array<double>").select(digest(F.col("t")).alias("digest"), "vector"), day)

    put(["a", "b"], "2024-01-01")
    put(["x", "y", "b", "b"], "2024-02-20")
    found = kept.looked_up(asked, "2024-03-01", 30)
    assert {r.key: (r.state, r.vector) for r in found.collect()} == {1: ("expired", None), 2: ("hit", [2.0]), 3: ("expired", None), 4: ("blank", None), 5: ("blank", None), 6: ("missing", None), 7: ("missing", None)}
    assert sorted(r.waiting for r in kept.to_make(asked, "2024-03-01", 30).collect()) == [1, 1, 2]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert spark.catalog.listTables() == [t for t in spark.catalog.listTables() if not t.name.startswith("bucketed_")]


def test_rules(spark):
    big = 11 * advice.GIGABYTE
    rows = [(1, 5, 0, 0, 10, 5, 64), (2, 0, 0, 0, 0, 5, 64), (3, 2_000_000, 3, 1, 60 * advice.GIGABYTE, 1001, 4000), (4, 7, 0, 2, big, 5, 64), (5, None, None, None, None, None, None)]
    figures = spark.createDataFrame(rows, "i long, documents long, invalid long, warnings long, bytes long, fields long, dimensions long")
    got = {r.i: (r.needs_reindex, [a["action"] for a in r.advice]) for r in advice.plan(figures).collect()}
    assert got == {1: (False, []), 2: (True, ["repository"]), 3: (True, ["drop-rebuild", "schema-update", "optimize"]), 4: (False, ["schema-update", "optimize"]), 5: (False, [])}
    hints = {r.i: [(a["action"], a["reason"]) for a in r.advice] for r in advice.matches(figures, advice.HINTS).collect()}
    assert [a for a, _ in hints[3]] == ["performance", "storage", "storage", "schema", "vectors"] and hints[4] == [("storage", "Index size is 11.00GB. Consider cleanup or archival")]


def test_exact_median(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 400):
        values = [rng.choice([1.5, 2.0, rng.random(), None]) for _ in range(n)] + [3.0]
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        assert analytics.exact_median(frame, F.col("v")).first()[0] == statistics.median([v for v in values if v is not None])
    assert analytics.exact_median(frame.limit(0), F.col("v")).first()[0] is None
    assert tuple(analytics.response_times(frame.limit(0), F.col("v")).first()) == (0.0, 0.0)


def test_siblings_across_ranges(spark):
    rows = [(i, "hot" if i % 5 else f"d{i % 3}") for i in range(300)] + [(1000, None)]
    frame = spark.createDataFrame(rows, "id long, d string").repartition(3)
    want = {}
    for i, d in rows:
        own = [j for j, e in rows if e == d]
        at = own.index(i)
        want[i] = (d, own[at - 1] if at else None, own[at + 1] if at + 1 < len(own) else None, len(own) - 1)
    assert {r.id: (r.directory, r.before, r.after, r.siblings) for r in joins.siblings(frame, "id", F.col("d")).collect()} == want


def test_chunks_by_repository_and_language(spark, tmp_path):
    rows = [("big" if i % 10 else "small", "py", i, "text " * 50) for i in range(500)]
    tables.write_chunks(spark.createDataFrame(rows, "repository string, language string, id long, text string"), f"file://{tmp_path}/chunks")
    back = spark.read.parquet(f"file://{tmp_path}/chunks")
    assert back.count() == 500 and back.filter("repository = 'small'").count() == 50
