"""Operators on literal inputs whose results were worked out by hand."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import chunking, clones, feedback, filters, fusion, graph, patterns, quality, ranking, retrieval, understanding
from loomquery.sources import repository, tables
from loomquery.streaming import events as streaming


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_truncation(spark):
    long = "x" * 32_001
    row = one(spark, fn.truncated(F.lit(long)).alias("t"), fn.is_truncated(F.lit(long)).alias("f"), fn.truncated(F.lit("short")).alias("s"))
    assert len(row.t) == 32_000 and row.t.endswith("...") and row.f and row.s == "short"


@pytest.mark.parametrize(
    "here, there, project, language, base",
    [("a/b/c", "a/b/c", False, False, 1.0), ("a/b/c", "a/b/d", False, False, 0.7), ("a/b/c", "a/x/d", False, False, 0.5), ("a/b", "x/y", True, True, 0.3), ("a/b", "x/y", False, True, 0.1), ("a/b", "x/y", False, False, 0.0), ("", "x", True, True, 0.0)],
)
def test_proximity(spark, here, there, project, language, base):
    got = one(spark, fn.path_proximity(F.lit(here), F.lit(there), F.lit(project), F.lit(language)).alias("b"))
    assert got.b == base
    damped = one(spark, fn.log_damped(F.lit(base)).alias("d")).d
    assert damped == pytest.approx(math.log(1 + 4 * base) / math.log(5) if base else 0.0)


def test_names(spark):
    row = one(spark, *[f(F.lit("parseHTTPRequest")).alias(n) for n, f in (("snake", fn.snake_case), ("pascal", fn.pascal_case), ("camel", fn.camel_case), ("kebab", fn.kebab_case), ("upper", fn.upper_case))])
    assert tuple(row) == ("parse_http_request", "ParseHttpRequest", "parseHttpRequest", "parse-http-request", "PARSE_HTTP_REQUEST")
    styles = one(spark, *[fn.naming_style(F.lit(x)).alias(x) for x in ("MAX_SIZE", "my_name", "myName", "MyName", "my-name")])
    assert tuple(styles) == ("upper", "snake", "camel", "pascal", "other")


def test_text_facts(spark):
    row = one(
        spark,
        fn.headline(F.lit("# note\n\n  first line\nsecond")).alias("headline"),
        fn.snippet(F.lit("a\nb\nc"), 2).alias("snippet"),
        fn.strip_tags(F.lit(" <b>x</b>&nbsp;y ")).alias("stripped"),
        fn.exact_terms(F.lit('find "exact phrase" in v 1.2.3 and call run(x)')).alias("terms"),
        fn.language_of(F.lit("src/A.TSX")).alias("language"),
        fn.mime_of(F.lit("x.unknown")).alias("mime"),
        fn.repository_of(F.lit("org/tool/src/a.py")).alias("repository"),
        fn.duration_minutes(F.lit("PT2H")).alias("minutes"),
        fn.masked_environment(F.lit("https://a.b/c in WestUS2 1.2.3 ACS_KEY")).alias("masked"),
        fn.context_type(F.lit("raise an Exception about vector size")).alias("context"),
        fn.unit_range(F.lit(float("nan")), F.lit(0.0), F.lit(1.0)).alias("nan"),
        fn.approx_tokens(F.lit("abc")).alias("tokens"),
        fn.sanitised(F.lit("a<script>x</script>b")).alias("clean"),
    )
    assert row.headline == "first line" and row.snippet == "a\nb" and row.stripped == "x y"
    assert row.terms == ["exact phrase", "1.2.3", "run"]
    assert (row.language, row.mime, row.repository, row.minutes) == ("typescript", "application/octet-stream", "tool", 120)
    assert row.masked == "<ENV_0>/c in <ENV_1> <ENV_2> <ENV_3>" and row.context == "vector_error_handling"
    assert (row.nan, row.tokens, row.clean) == (0.5, 1, "ab")


def test_filters(spark):
    docs = spark.createDataFrame([(1, "alpha beta", ["x"]), (2, "alpha gamma", None), (3, None, ["Beta"])], "id long, content string, tags array<string>")
    assert [r.id for r in docs.filter(filters.exclude_terms(["beta"], F.coalesce("content", F.lit("")), F.col("tags"))).collect()] == [2]
    assert docs.filter(filters.exact_terms(["a; drop"], [F.col("content")])).count() == 0
    assert filters.combine(None, None) is None


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b c"), (3, None)], "doc_id long, text string")
    hits = {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, spark.createDataFrame([(9, "A b")], "query_id long, text string")).collect()}
    n, avg = 3, 5 / 3

    def part(df, tf, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))

    assert hits == {(9, 1): pytest.approx(part(1, 2, 3) + part(2, 1, 3)), (9, 2): pytest.approx(part(2, 1, 2))}


def test_calibration_and_fusion(spark):
    same = spark.createDataFrame([(1, "k", i, 1.0) for i in range(3)], "query_id long, list string, id long, score double")
    assert {r.c for r in same.select(fusion.calibrated(F.col("score"), "query_id", "list").alias("c")).collect()} == {0.5}
    hits = spark.createDataFrame([(1, 0, 10, 4.0), (1, 0, 11, 2.0)], "query_id long, stage int, id long, score double")
    fused = {r.id: r.score for r in fusion.reciprocal_rank_fusion(hits).collect()}
    assert fused == {10: pytest.approx(0.7 / 61 + 0.3), 11: pytest.approx(0.7 / 62 + 0.15)}
    worthless = spark.createDataFrame([(1, 0, 10, -4.0)], "query_id long, stage int, id long, score double")
    assert fusion.reciprocal_rank_fusion(worthless).first().score == pytest.approx(0.7 / 61)


def test_budget_keeps_a_prefix(spark):
    hits = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, "x" * 80), (1, 3, "x" * 40)], "query_id long, id long, text string")
    kept = fusion.within_budget(hits, 25, "text", F.col("id"))
    assert [r.id for r in kept.collect()] == [1]
    context = fusion.assemble(fusion.within_budget(hits, 1000, "text", F.col("id")), "text", "used").first()
    assert context.citations == [1, 2, 3] and context.context.count("\n\n") == 2


def test_two_tiers_and_original_scores(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, None), (1, 2, 0.1, 0.2), (1, 3, 0.5, 0.7)], "query_id long, id long, score double, ce_score double")
    assert [r.id for r in fusion.rerank_two_tier(hits, 3).orderBy("place").collect()] == [3, 2, 1]
    assert one(spark, fusion.original_score(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0)).alias("s")).s == 3.0


def test_ranking_weights_add_up(spark):
    assert all(sum(w) == pytest.approx(1) for w in ranking.WEIGHTS.values())
    moved = ranking.weights_table(spark, {"debug": {"text_relevance": 5.0}}).groupBy("intent").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in moved)


def test_intents(spark):
    rows = [("how do i implement a parser", "implement"), ("fix this error: crash", "debug"), ("xyzzy", "understand"), ("unit test coverage for mock", "test"), (None, "understand")]
    found = spark.createDataFrame(rows, "q string, want string").select("want", understanding.classify_intent(F.col("q"))["intent"].alias("got")).collect()
    assert all(r.want == r.got for r in found)
    row = one(spark, understanding.expand_abbreviations(F.lit("db auth")).alias("a"), understanding.enhanced(F.lit("create db"), F.lit("debug")).alias("e"), understanding.acceptable(F.lit("a a"), F.lit("a b")).alias("bad"), understanding.validated(F.lit(" ../ ")).alias("v"))
    assert row.a == "database authentication authorization" and row.e[0] == "create db" and "make db" in row.e and not row.bad and row.v.error == "empty"


def test_sessions_and_rewards(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at + datetime.timedelta(minutes=m)) for m in (0, 30, 61)]
    found = feedback.sessions(spark.createDataFrame(rows, "u long, ts timestamp"), "u", "ts").orderBy("ts").collect()
    assert [r.session for r in found] == [1, 1, 2]
    signals = spark.createDataFrame([("click", 3), ("click", 5), ("copy", None)], "s string, p int")
    assert signals.select(F.sum(feedback.reward(F.col("s"), F.col("p"))).alias("r")).first().r == pytest.approx(0.9)
    shares = spark.createDataFrame([("g", 0.2), ("g", 0.6)], "g string, w double")
    new = feedback.updated_weights(shares, "g", "w", F.col("w"), F.lit(0.0)).collect()
    assert sum(r.weight for r in new) == pytest.approx(1)


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id long, t string")
    found = {r.field: tuple(r)[1:] for r in quality.coverage(docs, ["t"]).collect()}
    assert found == {"t": (3, 2, 1, 66.67)}
    assert {r.id for r in quality.missing(docs, "id", ["t"]).collect()} == {2, 3}


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6)], "k long, x string, y int")
    assert sorted(map(tuple, tables.replace_rows(old, new, "k").collect()), key=str) == sorted([(1, "a", 1), (2, None, 5), (3, "c", 6)], key=str)
    assert sorted(map(tuple, tables.merge_rows(old, new, "k").collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 6)]
    assert tables.schema_restore(spark, tables.schema_backup(old)).schema == old.schema
    big = spark.createDataFrame([(1, "x" * 1000)], "k long, content string")
    row = tables.clamp_rows(big, "content", 500).first()
    assert row.truncated and len(row.content) < 500


def test_json_log_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    schema = spark.createDataFrame([], "a long").schema
    assert sorted(r.a for r in tables.read_log(spark, str(tmp_path), schema).collect()) == [1, 2]


def test_repository_scan(spark, tmp_path):
    for name in ("src/main.py", "README.md", "node_modules/x.js", "build/y.py", ".git/config", "out/z.py", "notes.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("def f():\n    return g()\n")
    files = repository.scan(spark, f"file://{tmp_path}", "tool", ["out/", "# comment"])
    assert {r.path for r in files.collect()} == {"src/main.py", "README.md"}
    chunks = {(r.path, r.chunk_type, r.name) for r in chunking.chunk_files(files).collect()}
    assert chunks == {("src/main.py", "function", "f"), ("README.md", "file", None)}
    changes = spark.createDataFrame([("README.md", "modified"), ("src/main.py", "removed")], "path string, status string")
    assert [r.path for r in repository.changed(files, changes).collect()] == ["README.md"]
    names = spark.createDataFrame([("a_b-c.d", True), ("", False), ("a/b", False), ("!!!", False), ("x" * 101, False)], "n string, ok boolean")
    assert all(r.ok == r.got for r in names.select("ok", repository.valid_name(F.col("n")).alias("got")).collect())


def test_chunks_of_source():
    found = chunking.python_chunks("import os\nclass A(B):\n    def m(self, x=1):\n        '''doc'''\n        return os.getcwd()\n")
    assert [(c["chunk_type"], c["name"], c["start_line"], c["end_line"]) for c in found] == [("class", "A", 2, 5), ("function", "m", 3, 5)]
    assert found[1]["docstring"] == "doc" and found[1]["calls"] == ["os.getcwd"] and found[0]["imports"] == ["os"]
    assert chunking.python_chunks("def (")[0]["chunk_type"] == "file"
    script = chunking.script_chunks("import x from 'lib'\nexport function go(a) {\n  if (a) { run(a) }\n}\nclass K {\n}\nconst f = (y) => { y }\n")
    assert [(c["chunk_type"], c["name"]) for c in script] == [("function", "go"), ("class", "K"), ("function", "f")]
    assert script[0]["imports"] == ["lib"] and script[0]["calls"] == ["run"] and script[0]["content"].endswith("}")


def test_text_pages(spark):
    assert one(spark, chunking.pages(F.lit("abcdefghij"), 4, 1).alias("p")).p == ["abcd", "defg", "ghij"]


def test_patterns(spark):
    found = patterns.recognise(spark.createDataFrame([(1, "class MySingleton:\n    _instance = None"), (2, None)], "id long, code string"), "id", "code")
    row = patterns.dominant(found, "id").first()
    assert (row.pattern, row.confidence) == ("singleton", pytest.approx(3 / 4 * 0.4 + 2 / 4 * 0.5))


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 3)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.depth for r in graph.reachable(edges, start, 3).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.cycle for r in graph.cycles(edges, 3).collect()} == {"1>2>3", "3>4"}
    assert {(r.src, r.dst) for r in graph.indirect(edges).collect()} == {(1, 3), (2, 1), (2, 4), (3, 2), (4, 1)}


@pytest.mark.parametrize("few", [1, 6, 4096])
def test_second_steps_of_few_and_of_many(spark, few):
    edges = sorted({(i * 7 % 19, i * i % 23) for i in range(60)} | {(0, j) for j in range(1, 19)} | {(4, 4), (30, 0), (31, 32)})
    want = {(a, d) for a, b in edges for c, d in edges if b == c and a != d} - set(edges)
    frame = spark.createDataFrame(edges * 2 + [(None, 1), (1, None)], "src long, dst long")
    found = [(r.src, r.dst) for r in graph.indirect(frame, few).collect()]
    assert sorted(found) == sorted(want)


def test_block_clones(spark):
    body = "\n".join(f"line {i}" for i in range(8))
    files = spark.createDataFrame([("a", body), ("b", "intro\n" + body), ("c", "nothing")], "path string, text string")
    runs = clones.clone_runs(files, "path", "text").collect()
    assert [(r.key, r.source_key, r.start_line, r.source_start, r.n_lines) for r in runs] == [("b", "a", 2, 1, 8)]


def test_rate_limit_counts_accepted_requests_only(spark, tmp_path):
    rng, at = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = sorted((rng.choice("ab"), at + datetime.timedelta(seconds=rng.randint(0, 300))) for _ in range(120))
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "user string, ts timestamp, id long")
    numbered.coalesce(1).write.parquet(f"{tmp_path}/requests.parquet")
    requests = streaming.with_end(streaming.stream_table(spark, f"{tmp_path}/requests.parquet"), f"{tmp_path}/end")
    decided = streaming.rate_limited(requests, "user", "ts", "id", most=5, seconds=60, burst=2)
    last = spark.createDataFrame([("", at + datetime.timedelta(days=1), -1)], numbered.schema)
    got = streaming.drain(decided, f"file://{tmp_path}/out", end=(last, f"{tmp_path}/end")).collect()
    want = []
    for user in "ab":
        accepted = []
        for u, ts in sorted(rows, key=lambda r: r[1]):
            if u == user:
                recent = [t for t in accepted if (ts - t).total_seconds() < 60]
                ok = len(recent) < 5 and sum((ts - t).total_seconds() < 1 for t in recent) < 2
                want.append((user, ts, ok))
                if ok:
                    accepted.append(ts)
    assert sorted((r.user, r.ts, r.accepted) for r in got) == sorted(want)


def test_streaming_pairs(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (2, at)], "k long, ts timestamp").write.parquet(f"{tmp_path}/shown.parquet")
    spark.createDataFrame([(1, at + datetime.timedelta(minutes=5)), (2, at + datetime.timedelta(hours=3))], "k long, ts timestamp").write.parquet(f"{tmp_path}/chosen.parquet")
    pairs = streaming.paired(streaming.stream_table(spark, f"{tmp_path}/shown.parquet"), streaming.stream_table(spark, f"{tmp_path}/chosen.parquet"), "k", "ts")
    assert [r.k for r in streaming.drain(pairs, f"file://{tmp_path}/out").collect()] == [1]
