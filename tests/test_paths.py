"""Facts of paths against the standard library's."""

import fnmatch
import pathlib

from pyspark.sql import functions as F

from loomquery.functions import paths


def test_parts(spark):
    cases = ["a/b/c.py", "/x.tar.gz", "plain", ".bashrc", "a/.hidden", "dir/end.", "a/b/", "/top", "x/y.Z", "a//b.c"]
    frame = spark.createDataFrame([(c,) for c in cases], "p string")
    own = F.col("p")
    for r in frame.select("p", paths.name(own).alias("n"), paths.parent(own).alias("u"), paths.suffix(own).alias("s"), paths.stem(own).alias("t"), paths.test_path(own).alias("x")).collect():
        path = pathlib.PurePosixPath(r.p)
        ending = "" if path.name.endswith(".") else path.suffix  # a dot alone is no ending
        assert (r.n, r.s, r.t) == (path.name, ending, path.name[: len(path.name) - len(ending)]), r
        assert pathlib.PurePosixPath(r.u) == path.parent and pathlib.PurePosixPath(r.x) == path.parent / f"test_{path.name}", r


def test_languages(spark):
    frame = spark.createDataFrame([("a.PY",), ("b/c.mm",), ("none",), (None,), ("a.r",)], "p string")
    assert [r[0] for r in frame.select(paths.detected_language(F.col("p"))).collect()] == ["python", "objcpp", "unknown", "unknown", "r"]


def test_globs(spark):
    values = ["search:a", "search:ab", "search", "x[1]", "x1", "x\n", "a.b", "acb", "^", "]", "a-b"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    for glob in ("search:*", "search:?", "x[1]", "x[[]1]", "x[!1]", "*", "a.b", "a?b", "[^]", "[]]", "[!]]", "a[-x]b", "[a", "x*"):
        got = {r.v for r in frame.filter(paths.glob_matches(F.col("v"), glob)).collect()}
        assert got == {v for v in values if fnmatch.fnmatchcase(v, glob)}, glob


def test_names_and_tokens(spark):
    frame = spark.createDataFrame([("", "async def go(x)", "", ["a"], []), (None, None, "let y; function run (", None, ["b", "c"]), ("own", "def f", "", [], None), (None, "nothing", "class X", [], [])], "k string, s string, c string, h array<string>, d array<string>")
    rows = frame.select(paths.function_name(F.col("k"), F.col("s"), F.col("c")).alias("f"), paths.first_highlight(F.col("h"), F.col("d")).alias("h")).collect()
    assert [tuple(r) for r in rows] == [("go", "a"), ("run", "b"), ("own", None), (None, None)]
    texts = spark.createDataFrame([("find \"exact phrase\" and 'other é' in 42 or 3.14 v10 7 2024",), (None,), ("'" + "x" * 300 + "'",), ("' ' \"\"",)], "q string")
    got = [r[0] for r in texts.select(paths.exact_tokens(F.col("q"))).collect()]
    assert got == [["exact phrase", "other ", "42", "2024"], None, ["x" * 200], []]
