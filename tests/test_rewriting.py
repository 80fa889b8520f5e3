"""Wordings by hand."""

import pytest
from pyspark.sql import functions as F

from loomquery.operators import rewriting
from loomquery.operators.understanding import words


@pytest.mark.parametrize(
    ("made", "query", "expected"),
    [
        (lambda q: rewriting.swapped(words(q)), "parse json file", {"json parse file", "parse file json"}),
        (lambda q: rewriting.swapped(words(q)), "parse the file", set()),
        (lambda q: rewriting.swapped(words(q)), "one two three four five six", set()),
        (lambda q: rewriting.rephrased(q, words(q)), "how to parse json", {"parse json tutorial"}),
        (lambda q: rewriting.rephrased(q, words(q)), "create a view", {"how to create a view"}),
        (lambda q: rewriting.rephrased(q, words(q)), "class of things", {"what is class of things"}),
        (lambda q: rewriting.gerunds(words(q)), "create and get", {"creating and get", "create and geting"}),
        (lambda q: rewriting.substituted(words(q), {"db": ["database"], "get": ["fetch", "load"]}), "get db", {"fetch db", "load db", "get database"}),
        (lambda q: rewriting.templated(q, words(q), F.lit("debug")), "fix timeout", {"timeout example", "timeout implementation", "timeout sample code", "timeout usage", "timeout error", "resolve timeout", "timeout troubleshooting", "debug timeout", "fix timeout"}),
        (lambda q: rewriting.by_intent(q, F.lit("test")), "mock it", {"mock it unit test", "unit test mock it", "mock it test case", "test case mock it", "mock it assertion", "assertion mock it"}),
        (lambda q: rewriting.by_intent(q, F.lit(None).cast("string")), "mock it", set()),
        (lambda q: rewriting.by_context(q, F.lit("Python"), F.lit(None).cast("string"), F.array(F.lit("orders.repo"), F.lit("zz.a"))), "orders", {"orders python", "orders python syntax", "orders repo"}),
    ],
)
def test_generators(spark, made, query, expected):
    frame = spark.createDataFrame([(query,)], "q string")
    assert set(frame.select(made(F.col("q")).alias("v")).first().v) == expected


def test_rank_and_awkward_queries(spark):
    rows = [(1, "create a view", "implement"), (2, None, "debug"), (3, "  ", None), (4, "create a view", "implement")]
    found = rewriting.rewrites(spark.createDataFrame(rows, "id long, q string, intent string"), "id", "q", "intent", most=4).collect()
    of = {k: [(r.rank, r.variant) for r in sorted(found, key=lambda r: r.rank) if r.id == k] for k in (1, 2, 3, 4)}
    assert of[1][0] == (1, "create a view") and [r for r, _ in of[1]] == [1, 2, 3, 4] and of[1] == of[4]
    assert (1, "") in of[2] + of[3] and all(v == "" or "view" not in v for _, v in of[2] + of[3])
    assert rewriting.rewrites(spark.createDataFrame([], "id long, q string, intent string"), "id", "q", "intent").count() == 0
