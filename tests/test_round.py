"""Operators at their limits: large batches of terms and passages, hot groups, plain parts of expressions."""

import re

import pytest
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import clones, feedback, patterns, retrieval
from loomquery.sources.stored import shared_dir


def hits(spark, **more):
    docs = spark.createDataFrame([(1, "alpha beta beta", "x alpha"), (2, "gamma alpha", "beta"), (3, None, None), (4, "delta", "gamma")], "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, "alpha beta delta"), (2, "gamma")], "query_id long, text string")
    return {(r.query_id, r.id): round(r.score, 9) for r in retrieval.bm25(docs, asked, **more).collect()}


@pytest.mark.parametrize("fields", [None, {"text": 1.0, "title": 2.0}])
def test_bm25_beyond_the_literal_terms(spark, monkeypatch, fields):
    few = hits(spark, fields=fields)
    monkeypatch.setattr(retrieval, "LITERAL_TERMS", 1)
    assert hits(spark, fields=fields) == few and len(few) == (4 if fields is None else 5)


def test_fields_add_up(spark):
    both, text, title = hits(spark, fields={"text": 1.0, "title": 2.0}), hits(spark), hits(spark, text_col="title")
    assert both == {k: pytest.approx(text.get(k, 0) + 2 * title.get(k, 0)) for k in text | title}


def test_passages_beyond_the_literals(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b"), (3, None), (4, "six five four three two one")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "two three four five six"), (2, "A, b!"), (3, "nothing like it here at all")], "item_id long, text string")

    def found():
        return sorted(map(tuple, clones.passages_contained(texts, "doc_id", "text", passages, "item_id", "text", 0.8).collect()))

    few = found()
    monkeypatch.setattr(clones, "MOST_LITERALS", 1)
    assert found() == few == [(1, 1, 1.0), (2, 2, 1.0)]


def test_plain_parts_are_in_every_match():
    samples = ["class MySingleton", "create_it (", "@router.post", "len(my_vector) !=", "x.shape[0] !=", "def test_a", "class A(models.Model)", "import x from 'react'", "super().__init__", "async def f(a, request", "if not x: raise", "expect(a)"]
    for _, _, _, expressions in patterns.PATTERNS:
        for e in expressions:
            for s in samples:
                found = re.search(e, s)
                assert not found or patterns.required(e) in found[0]


def test_exact_terms_equal_the_plain_expressions(spark):
    texts = ["say \"it's here\" now", "'a b' \"c\" v2.0.1 and 3.14. or 42 x7 99a .55", "call( foo (x) bar2(", "été(1) \"\" '' 10,20 1.2.3x", "", None, "\" \" ' '"]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn.exact_terms(F.col("t"))).collect()]

    def plain(text):
        terms = [a or b for a, b in re.findall(r"\"([^\"]+)\"|'([^']+)'", text)]
        return list(dict.fromkeys(terms + re.findall(r"(?<!\w)(\d+(?:\.\d+)+|\d{2,})(?![\w.])", text) + re.findall(r"(\w+)\s*\(", text)))

    assert found == [None if t is None else plain(t) for t in texts]


def test_running_mean_of_a_hot_group(spark):
    rows = [(i, "hot" if i % 10 else None, float(i % 7) if i % 5 else None) for i in range(300)]
    got = {r.i: r.mean_so_far for r in feedback.running_mean(spark.createDataFrame(rows, "i long, g string, v double"), "g", ["i"], "v").collect()}
    for group in ("hot", None):
        seen = []
        for i, g, v in rows:
            if g == group:
                seen += [v] if v is not None else []
                assert got[i] == (pytest.approx(sum(seen) / len(seen)) if seen else None)


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Elsewhere)
