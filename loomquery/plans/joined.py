"""Joins around results, hybrid search with all its lists, and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import filters, fusion, joins, retrieval
from loomquery.plans.ranked import _RRF, _TWO_LISTS, _staged, two_lists
from loomquery.plans.registry import query, rounded, table

_EXACT = "SELECT doc_id AS id FROM documents WHERE contains(text, 'License') AND contains(text, 'Version 2.0')"


@query(f"""
    {_TWO_LISTS},
    every AS (SELECT 'keyword' AS list, 0.4 AS w, id, score FROM keyword UNION ALL SELECT 'vector', 0.4, id, score FROM vector),
    z AS (SELECT id, w / (1 + exp(-(greatest(score, 0) - avg(greatest(score, 0)) OVER o) / coalesce(nullif(stddev_pop(greatest(score, 0)) OVER o, 0), 1))) AS part FROM every WINDOW o AS (PARTITION BY list)),
    all_parts AS (SELECT id, part, 0 AS hit FROM z UNION ALL SELECT id, 0.35, 1 FROM ({_EXACT})),
    fused AS (SELECT id, sum(part) AS score, max(hit) = 1 AS exact_boost FROM all_parts GROUP BY id)
    SELECT id, round(score, 6) AS score, exact_boost FROM fused
""")
def hybrid_three_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector lists, calibrated and weighted, and a fixed boost for documents that hold the exact terms."""
    exact = table(spark, sf_dir, "documents").filter(filters.exact_terms(["License", "Version 2.0"], [F.col("text")])).select(F.lit(1).cast("long").alias("query_id"), F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    return rounded(fusion.hybrid(two_lists(spark, sf_dir), exact, {"keyword": 0.4, "vector": 0.4}, 0.35).select("id", "score", "exact_boost"), "score")


@query(f"""
    {_TWO_LISTS},
    z AS (SELECT id, 0.6 / (1 + exp(-(greatest(score, 0) - avg(greatest(score, 0)) OVER ()) / coalesce(nullif(stddev_pop(greatest(score, 0)) OVER (), 0), 1))) AS score FROM vector)
    SELECT id, round(coalesce(z.score, 0), 6) AS score FROM z FULL OUTER JOIN keyword USING (id)
""")
def hybrid_back_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form: one vector weight, the rest for semantic hits, nothing for plain keyword hits."""
    none = two_lists(spark, sf_dir).limit(0).select("query_id", "id", "score")
    return rounded(fusion.hybrid(two_lists(spark, sf_dir), none, {"vector": 0.6, "semantic": 0.4, "keyword": 0.0}, 0.35).select("id", "score"), "score")


@query(f"""
    {_RRF},
    best AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM fused)
    SELECT rank, id, round(score, 6) AS score, source, lang, n_chars FROM best JOIN documents ON doc_id = id WHERE rank <= 20
""")
def fused_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.top_per_query(fusion.reciprocal_rank_fusion(_staged(two_lists(spark, sf_dir))), 20, F.round("score", 9).desc(), F.col("id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return rounded(joins.with_documents(best, docs).select("rank", "id", "score", "source", "lang", "n_chars"), "score")


@query(f"""
    {_RRF},
    known AS (SELECT id, list_sort(list(DISTINCT stage)) AS stages, min(stage) AS first_stage, arg_min(score, stage) FILTER (score <> 0) AS first FROM every GROUP BY id)
    SELECT f.id, round(f.score, 6) AS score, array_to_string(stages, ',') AS stages, CAST(first_stage AS BIGINT) AS first_stage, round(coalesce(first, f.score), 6) AS original FROM fused f LEFT JOIN known USING (id)
""")
def fused_stage_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = _staged(two_lists(spark, sf_dir))
    found = joins.with_stages(fusion.reciprocal_rank_fusion(staged), staged)
    return rounded(found.select("id", "score", F.concat_ws(",", F.transform("stages", lambda s: s.cast("string"))).alias("stages"), F.col("first_stage").cast("long").alias("first_stage"), "original"), "score", "original")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"""
    SELECT event_id, user_id, {_K} AS item FROM events v WHERE event_type = 'view'
      AND EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND CAST(json_extract(c.props, '$.k') AS BIGINT) = CAST(json_extract(v.props, '$.k') AS BIGINT))
""")
def shown_and_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of items that the same user clicked at any time."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _k().alias("item"))
    shown, clicked = (events.filter(F.col("event_type") == t).drop("event_type") for t in ("view", "click"))
    return joins.selected_of(shown, clicked, ["user_id", "item"])


@query("""
    WITH r AS (SELECT user_id, arg_max(value, (ts, event_id)) AS rating FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT event_id, user_id, rating FROM events LEFT JOIN r USING (user_id) WHERE event_type = 'purchase'
""")
def latest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the newest rating of their user."""
    events = table(spark, sf_dir, "events")
    found = joins.with_latest(events.filter("event_type = 'purchase'"), events.filter("event_type = 'signup'"), "user_id", ["ts", "event_id"], "value", "rating")
    return found.select("event_id", "user_id", "rating")


@query(f"""
    WITH f AS (SELECT user_id, arg_max({_K} % 10 + 1, (ts, event_id)) AS clicked_position FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT event_id AS decision, user_id AS query_id, clicked_position, clicked_position IS NOT NULL AS answered FROM events LEFT JOIN f USING (user_id) WHERE event_type = 'view'
""")
def decisions_with_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking decisions with the last feedback to their query."""
    events = table(spark, sf_dir, "events").withColumn("position", _k() % 10 + 1)
    found = joins.with_latest(events.filter("event_type = 'view'"), events.filter("event_type = 'click'"), "user_id", ["ts", "event_id"], "position", "clicked_position")
    return found.select(F.col("event_id").alias("decision"), F.col("user_id").alias("query_id"), "clicked_position", F.col("clicked_position").isNotNull().alias("answered"))


@query("""
    SELECT a.l_orderkey AS order_key, a.l_linenumber AS line, b.l_linenumber AS other, a.l_suppkey AS supplier
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber <> b.l_linenumber
""")
def same_file_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one order that need the same supplier, each with the others."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    found = joins.same_name_pairs(lines, "l_orderkey", "l_linenumber", "l_suppkey")
    return found.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "other", F.col("l_suppkey").alias("supplier"))


_HOST = "split_part(regexp_replace(url, '^https?://', ''), '/', 1)"


@query(f"""
    SELECT page_id, {_HOST} AS directory, count(*) OVER (PARTITION BY {_HOST}) - 1 AS siblings, lag(page_id) OVER o AS before, lead(page_id) OVER o AS after
    FROM pages WINDOW o AS (PARTITION BY {_HOST} ORDER BY page_id)
""")
def sibling_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1))
    return joins.siblings(table(spark, sf_dir, "pages"), "page_id", host).select("page_id", "directory", "siblings", "before", "after")


@query("""
    WITH wanted AS (SELECT n_nationkey, 'Brand#' || n_nationkey AS base FROM nation),
    tried AS (SELECT n_nationkey, base || e AS path, place FROM wanted, (VALUES ('', 1), ('0', 2), ('1', 3), ('2', 4)) AS v(e, place)),
    found AS (SELECT n_nationkey, arg_min(path, place) AS resolved FROM tried WHERE path IN (SELECT p_brand FROM part) GROUP BY n_nationkey)
    SELECT * FROM found
""")
def import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name resolved by trying its endings in order against the names that exist."""
    wanted = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("base"))
    return joins.first_existing(wanted, "n_nationkey", "base", table(spark, sf_dir, "part"), "p_brand", ["", "0", "1", "2"])


@query("""
    WITH feed AS (SELECT user_id AS o_custkey, arg_max(event_type = 'error', (ts, event_id)) AS gone, arg_max(value, (ts, event_id)) AS amount FROM events GROUP BY user_id),
    base AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY o_custkey)
    SELECT o_custkey, amount FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM feed)
    UNION ALL SELECT o_custkey, amount FROM feed WHERE NOT gone
""")
def change_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' amounts after a feed of changes; the newest change of a key counts, an error removes it."""
    base = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    feed = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.col("value").alias("amount"), "event_type", "ts", "event_id")
    return joins.apply_changes(base, feed, "o_custkey", ["ts", "event_id"], F.col("event_type") == "error")
