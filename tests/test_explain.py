"""Pattern scores, structures, joins and statistics on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from loomquery.operators import analytics, explain, joins


def test_structural_patterns(spark):
    codes = {
        1: ("class A:\n    _instance = None", "python", {"singleton": 0.8}),
        2: ("getInstance _instance", "java", {"singleton": 0.6}),
        3: ("def create_it(a) -> B:\n  pass", "python", {"factory": 0.7}),
        4: ("class MyFactory: subscribe notify", "python", {"factory": 0.8, "observer": 0.7}),
        5: ("@wrap\ndef f(): await x", "python", {"decorator": 0.6, "async": 0.9}),
        6: ("Promise", "javascript", {"async": 0.9}),
        7: ("Promise", "python", {}),
        8: (None, None, {}),
        9: ("class A:\n" + "x = 1\n" * 5000 + "_instance = None", "java", {"singleton": 0.8}),
        10: ("_instance = None\nclass A", None, {}),
        11: ("def create_it(" + "a, " * 500 + "b) -> B:", "java", {"factory": 0.7}),
        12: ("x) -> y: def create_it(", "java", {}),
        13: ("class MyObserver(Decorator) class MyDecorator", "python", {"observer": 0.8, "decorator": 0.8}),
        14: ("async def f", "python", {"async": 0.9}),
        15: ("async f", "typescript", {"async": 0.9}),
    }
    table = spark.createDataFrame([(i, c, lang) for i, (c, lang, _) in codes.items()], "i long, c string, l string")
    got = {r.i: r.p for r in table.select("i", explain.structural_patterns(F.col("c"), F.col("l")).alias("p")).collect()}
    assert got == {i: want for i, (_, _, want) in codes.items()}


def test_pattern_score(spark):
    found = spark.createDataFrame([(1, "factory", 0.5), (1, "state", 0.4), (2, "wrapper", 0.6), (3, "other", 0.9)], "k long, pattern string, confidence double")

    def scores(expected):
        return {r.k: r.pattern_match for r in explain.pattern_score(found, "k", expected).collect()}

    assert scores(["factory", "strategy"]) == {1: pytest.approx((0.5 + 0.28) / 2 * 1.2), 2: 0.0, 3: 0.0}
    assert scores(["decorator"]) == {1: 0.0, 2: pytest.approx(0.42), 3: 0.0}
    assert set(scores([]).values()) == {0.5}


def test_scores_that_are_no_numbers(spark):
    rows = [(1, 2.0), (1, float("nan")), (1, 4.0), (1, None), (2, 3.0), (2, 3.0), (3, float("inf"))]
    got = [r.s for r in spark.createDataFrame(rows, "g long, v double").select("g", analytics.clean_minmax(F.col("v"), "g").alias("s")).orderBy("g", "s").collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 0.5, 0.5, 0.5]


def test_consistency_of_style(spark):
    words = spark.createDataFrame([("a", "one_two")] * 3 + [("a", "OneTwo")] + [("b", "x")], "g string, w string")
    got = {r.g: (r.style, r.n, round(r.consistency, 9)) for r in analytics.style_vote(words, "g", "w").collect()}
    entropy = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2)
    assert got == {"a": ("snake", 3, round(1 - entropy, 9)), "b": ("snake", 1, 1.0)}


def test_changes_are_applied(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    feed = spark.createDataFrame([(1, "x", "set", 1), (1, "y", "set", 2), (2, None, "drop", 3), (4, "z", "set", 1), (3, "w", "drop", 1), (3, "w", "set", 2)], "k long, v string, op string, at long")
    got = dict(joins.apply_changes(base, feed, "k", ["at"], F.col("op") == "drop").collect())
    assert got == {1: "y", 3: "w", 4: "z"}


def test_joins_of_nothing(spark):
    hits = spark.createDataFrame([], "query_id long, stage int, id long, score double")
    assert joins.with_stages(hits.drop("stage"), hits).count() == 0
    assert joins.first_existing(spark.createDataFrame([(1, "a")], "k long, b string"), "k", "b", spark.createDataFrame([("a.py",), ("a",)], "p string"), "p", [".js", ".py", ""]).collect()[0].resolved == "a.py"
