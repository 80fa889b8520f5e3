"""Statistics over events, conversations, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import analytics, feedback, retrieval, understanding
from loomquery.plans.behaviour import AS_OF
from loomquery.plans.registry import query, rounded, table
from loomquery.plans.texts import _INTENT_SQL, _context_sql, _when_any


@query("""
    SELECT count(*) AS total, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS success_rate, round(avg(value) FILTER (event_type = 'signup'), 6) AS mean_rating, count(value) FILTER (event_type = 'signup') AS rated FROM events
""")
def feedback_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return rounded(analytics.outcome_statistics(table(spark, sf_dir, "events"), kind == "purchase", F.when(kind == "signup", F.col("value"))), "success_rate", "mean_rating")


@query("SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events WHERE value <> 0")
def response_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.response_times(table(spark, sf_dir, "events"), F.col("value")), "mean", "median")


@query("SELECT event_type, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type")
def factor_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.shares(table(spark, sf_dir, "events"), "event_type", "value"), "share")


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) - count(DISTINCT round(value, 1)) AS ties FROM events GROUP BY 1)
    SELECT count(*) AS days, round(avg(ties), 6) AS mean_ties, max(n) AS most_results FROM d
""")
def performance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.countDistinct(F.round("value", 1))).alias("ties"))
    return rounded(days.agg(F.count(F.lit(1)).alias("days"), F.avg("ties").alias("mean_ties"), F.max("n").alias("most_results")), "mean_ties")


@query(f"""
    WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e),
    t AS (SELECT user_id, session, min(ts) AS a, max(ts) AS z, count(*) AS n FROM s GROUP BY user_id, session)
    SELECT count(*) AS sessions, count(*) FILTER (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(z) < 1800000000) AS active, CAST(sum(n) AS BIGINT) AS interactions, round(CAST(sum(epoch_us(z) - epoch_us(a)) AS BIGINT) / count(*) / 60000000, 4) AS mean_minutes FROM t
""")
def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = feedback.sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts")
    each = own.groupBy("user_id", "session").agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count(F.lit(1)).alias("n"))
    return analytics.session_totals(each, "a", "z", "n", F.lit(AS_OF).cast("timestamp")).withColumn("mean_minutes", F.round("mean_minutes", 4))


_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '')"


@query(f"""
    WITH p AS (SELECT split_part({_PATH}, '/', 1) AS host, split_part({_PATH}, '/', 2) AS directory, split_part(url, ':', 1) AS scheme FROM pages)
    SELECT 'host' AS dimension, host AS value, count(*) AS n FROM p GROUP BY host
    UNION ALL SELECT 'directory', directory, count(*) FROM p GROUP BY directory
    UNION ALL SELECT 'scheme', scheme, count(*) FROM p GROUP BY scheme
""")
def session_file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, directories and schemes of the pages, counted in one pass."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", "")
    parts = table(spark, sf_dir, "pages").select(F.split_part(path, F.lit("/"), F.lit(1)).alias("host"), F.split_part(path, F.lit("/"), F.lit(2)).alias("directory"), F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"))
    return retrieval.report(parts, "host", "directory", "scheme")


_LOW = "lower(coalesce(text, chr(32)))"


@query(f"SELECT {_context_sql(_LOW)} AS context_type, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", fn.context_type(F.col("text")).alias("context_type"))
    return docs.groupBy("context_type").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


# What puts a hit into a bucket, in order.
_BUCKET_WORDS = {
    "vector_errors": ["dimension mismatch", "nan", "none embedding"],
    "vector_initialization": ["create_embedding", "initialize_vector", "embedder", "vectorizer"],
    "vector_search": ["vector_search", "similarity_search", "knn", "cosine"],
}


@query(f"""
    WITH c AS (SELECT doc_id, n_chars, lower(coalesce(text, '')) AS low, {_context_sql(_LOW)} AS kind FROM documents),
    b AS (SELECT doc_id, n_chars, CASE WHEN kind = 'vector_error_handling' OR {_when_any("low", _BUCKET_WORDS["vector_errors"])} THEN 'vector_errors'
        WHEN {_when_any("low", _BUCKET_WORDS["vector_initialization"])} THEN 'vector_initialization' WHEN {_when_any("low", _BUCKET_WORDS["vector_search"])} THEN 'vector_search'
        WHEN kind = 'configuration' THEN 'configuration' WHEN kind IN ('implementation', 'vector_implementation') THEN 'implementation'
        WHEN kind = 'testing' THEN 'testing' WHEN kind = 'documentation' THEN 'documentation' ELSE 'other' END AS bucket FROM c)
    SELECT bucket, doc_id, row_number() OVER (PARTITION BY bucket ORDER BY n_chars DESC, doc_id) AS place FROM b QUALIFY place <= 100
""")
def pattern_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in the first bucket it fits, the hundred longest of each."""
    low, kind = F.lower(F.coalesce("text", F.lit(""))), fn.context_type(F.col("text"))

    def has(bucket: str):
        return understanding.has_any(low, _BUCKET_WORDS[bucket])

    bucket = (
        F.when((kind == "vector_error_handling") | has("vector_errors"), "vector_errors")
        .when(has("vector_initialization"), "vector_initialization")
        .when(has("vector_search"), "vector_search")
        .when(kind.isin("implementation", "vector_implementation"), "implementation")
        .when(kind.isin("configuration", "testing", "documentation"), kind)
        .otherwise("other")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", bucket.alias("bucket"))
    return retrieval.top_per_query(docs, 100, F.desc("n_chars"), F.col("doc_id"), query_col="bucket").select("bucket", "doc_id", F.col("rank").alias("place"))


@query("""
    WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, arg_max(value, (ts, event_id)) AS latest FROM k WHERE r <= 1000 GROUP BY event_type
""")
def operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analytics.operation_metrics(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"]), "mean")


_STYLE = """CASE WHEN regexp_full_match(w, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'upper' WHEN regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake'
    WHEN regexp_full_match(w, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(w, '([A-Z][a-z0-9]*)+') THEN 'pascal' ELSE 'other' END"""


@query(f"""
    WITH s AS (SELECT source, {_STYLE} AS style, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents) GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS kinds FROM s)
    SELECT source, arg_max(style, (n, style)) AS style, max(n) AS n, round(CASE WHEN max(kinds) > 1 THEN 1 + sum(n / total * ln(n / total)) / ln(max(kinds)) ELSE 1 END, 6) AS consistency FROM t GROUP BY source
""")
def style_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naming style of most words of each source, and how far the source keeps to one."""
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("w"))
    return rounded(analytics.style_vote(words, "source", "w"), "consistency")


@query("""
    WITH l AS (SELECT source, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS n FROM documents)
    SELECT source, CAST(least(120, list_sort(list(n))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1]) AS BIGINT) AS line_length FROM l GROUP BY source
""")
def style_line_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.line_length(table(spark, sf_dir, "documents"), "source", "text")


@query("""
    WITH f AS (SELECT lang, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS members FROM documents),
    n AS (SELECT lang, member, count(*) AS n FROM (SELECT lang, unnest(members) AS member FROM f) GROUP BY ALL),
    size AS (SELECT lang, count(*) AS files FROM f GROUP BY lang)
    SELECT lang, member, round(n / files, 6) AS support FROM n JOIN size USING (lang) WHERE n / files >= 0.3
""")
def common_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that three tenths of a language's documents share."""
    docs = table(spark, sf_dir, "documents").select("lang", F.array_distinct(fn.tokens(F.coalesce("text", F.lit("")))).alias("members"))
    return rounded(analytics.common_members(docs, "lang", "members"), "support")


@query(f"SELECT intent, count(*) AS n, round(avg(score), 6) AS mean_score FROM ({_INTENT_SQL}) GROUP BY intent")
def model_update_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(understanding.classify_intent(F.col("text")).alias("x")).select("x.intent", F.round("x.score", 6).alias("score"))
    return rounded(turns.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")), "mean_score")


@query("""
    SELECT event_type, count(*) AS n, round(greatest(-0.05, least(0.05, (avg(least(1, value / 20)) - 0.5) * 0.1)), 6) AS adjustment FROM events GROUP BY event_type HAVING count(*) >= 5
""")
def adjustments_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each kind's weight may move; kinds with fewer than five signals don't."""
    signals = table(spark, sf_dir, "events").select("event_type", F.least(F.lit(1.0), F.col("value") / 20).alias("v"))
    return rounded(analytics.learned_by_intent(signals, "event_type", "v"), "adjustment")


@query("""
    SELECT count(*) AS processed, count(v.vec_id) AS enriched, count(*) FILTER (v.vec_id IS NULL AND length(trim(coalesce(text, ''))) = 0) AS failed,
           count(*) FILTER (v.vec_id IS NULL AND length(trim(coalesce(text, ''))) > 0) AS open
    FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON v.vec_id = d.doc_id
""")
def enrichment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return analytics.enrichment(table(spark, sf_dir, "documents"), vectors, "doc_id", F.col("text"))


@query("""
    SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.5 END, 6) AS scaled
    FROM events WINDOW w AS (PARTITION BY user_id)
""")
def scores_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", analytics.clean_minmax(F.col("value"), "user_id").alias("scaled")), "scaled")


@query("""
    SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 10
""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id", "place")


@query("""
    WITH l AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS item, max((ts, event_id)) AS last FROM events GROUP BY ALL)
    SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM l QUALIFY place <= 10
""")
def last_distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k").cast("long"))
    return analytics.newest_distinct(events, "user_id", "item", ["ts", "event_id"], 10)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten thousand newest events; older ones leave the log."""
    return analytics.newest(table(spark, sf_dir, "events"), None, ["ts", "event_id"], 10_000).select("event_id")
