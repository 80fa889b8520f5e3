"""Innermost scopes against all pairs."""

import os
import random

import pytest

from loomquery.operators import scopes
from loomquery.plans import catalog
from tests.conftest import DATA
from tests.oracle import TABLES, differences


def test_innermost(spark):
    rng = random.Random(1)
    ranges = [(rng.choice("ab"), s, s + rng.choice([0, 1, 2, 3, 7, 40, 300]), f"r{i % 7}") for i, s in enumerate(rng.choices(range(400), k=150))] + [("a", None, 5, "x"), (None, 0, 900, "x"), ("a", 0, 1000, "all"), ("a", 0, 1000, "also")]
    points = [(k, at, i) for i, (k, at) in enumerate([(k, at) for k in "abc" for at in range(0, 420, 3)] + [("a", None), (None, 3), ("a", -5), ("a", 3), ("a", 1000), ("a", 999)])]
    found = scopes.innermost(spark.createDataFrame(points, "key string, at long, id long").repartition(3), spark.createDataFrame(ranges, "key string, start long, end long, name string").repartition(3))
    for r in found.collect():
        inside = [(e - s, -s, n) for k, s, e, n in ranges if None not in (k, s, e) and k == r.key and r.at is not None and s <= r.at < e]
        want = min(inside, default=None)
        assert (r.inner is None) == (want is None), r
        assert want is None or (r.inner["end"] - r.inner["start"], -r.inner["start"], r.inner["name"]) == want, (r, want)
    assert found.count() == len(points)


def test_marks_and_scopes(spark):
    page = "<html><ul><li>a</li><LI>b</li></ul><!-- x --><p>1 < 2</p>"
    texts = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "no tag")], "id long, text string")
    marks = scopes.marks(texts, "id", "text")
    assert all(page[r.at] == "<" and page[r.at + 1 + r.closing :].lower().startswith(r.name) for r in marks.collect())
    found = {(r.name, r.nth): page[r.start : r.end] for r in scopes.scopes(marks, ["li", "ul", "html"]).collect()}
    assert found == {("li", 1): "<li>a", ("li", 2): "<LI>b", ("ul", 1): "<ul><li>a</li><LI>b</li>"}


def test_no_ranges(spark):
    points = spark.createDataFrame([("a", 1)], "key string, at long")
    none = spark.createDataFrame([], "key string, start long, end long, name string")
    assert [r.inner for r in scopes.innermost(points, none).collect()] == [None]


@pytest.mark.parametrize("name", ["link_scopes", "scope_call_graph"])
def test_long_tags_are_read_whole(spark, tmp_path, name):
    """A link's target may stand behind any number of other attributes, or be long itself."""
    filler = "x" * 1000
    pages = [
        (1, f'<ul><li><a data-a="{filler}" href="/far">a</a></li></ul>'),
        (2, f'<nav><a href="/{filler}/end">b</a></nav><A\nclass="{filler}"\nhref="/other">c</A>'),
        (3, f'<a>{filler} href="/text"</a><a/><a><abbr href="/no"></abbr>'),
    ]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for other in set(TABLES) - {"pages"}:
        os.symlink(f"{DATA}/{other}.parquet", f"{tmp_path}/{other}.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    targets = {r["target" if name == "link_scopes" else "callee"] for r in found}
    assert {"/far", f"/{filler}/end", "/other", "/text", ""} == targets
    assert differences(spark, str(tmp_path), name) is None
