"""Fusion, ranking and shaping of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import fusion, ranking, retrieval
from loomquery.plans.registry import query, rounded, table
from loomquery.plans.search import _values, asked, bm25_sql

ONE = [(1, "license version und der")]
_BM25 = bm25_sql(_values(ONE)).replace("(VALUES " + _values(ONE) + ")", "(VALUES " + _values(ONE) + ") AS v(query_id, text)")
# Vectors and documents share their numbers: document i is taken to have vector i.
_TWO_LISTS = f"""
    WITH {_BM25},
    keyword AS (SELECT doc_id AS id, score FROM scored ORDER BY round(score, 9) DESC, id LIMIT 50),
    vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    vector AS (
        SELECT c.id, list_cosine_similarity(c.e, q.e) AS score FROM vec c, vec q WHERE q.id = 1 ORDER BY round(score, 9) DESC, id LIMIT 50
    )"""


def two_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, list, id, score: 50 hits by BM25 and 50 by cosine."""
    keyword = retrieval.top_per_query(retrieval.bm25(table(spark, sf_dir, "documents"), asked(spark, ONE)), 50, F.round("score", 9).desc(), F.col("id"))
    v = table(spark, sf_dir, "embeddings")
    one = v.filter("vec_id = 1").select(F.lit(1).cast("long").alias("query_id"), F.col("embedding").alias("q"))
    vector = retrieval.cosine_top_k(v, one, 50)
    return keyword.select("query_id", F.lit("keyword").alias("list"), "id", "score").unionByName(vector.select("query_id", F.lit("vector").alias("list"), "id", "score"))


@query(f"""
    {_TWO_LISTS},
    every AS (SELECT 'keyword' AS list, id, score FROM keyword UNION ALL SELECT 'vector', id, score FROM vector),
    z AS (SELECT list, id, 1 / (1 + exp(-(score - avg(score) OVER w) / coalesce(nullif(stddev_pop(score) OVER w, 0), 1))) AS calibrated FROM every WINDOW w AS (PARTITION BY list))
    SELECT list, id, round(calibrated, 6) AS calibrated FROM z
""")
def zscore_sigmoid_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = two_lists(spark, sf_dir)
    return rounded(hits.select("list", "id", fusion.calibrated(F.col("score"), "query_id", "list").alias("calibrated")), "calibrated")


@query(f"""
    {_TWO_LISTS},
    every AS (SELECT 'keyword' AS list, 0.4 AS w, id, score FROM keyword UNION ALL SELECT 'vector', 0.4, id, score FROM vector),
    z AS (SELECT id, w / (1 + exp(-(score - avg(score) OVER o) / coalesce(nullif(stddev_pop(score) OVER o, 0), 1))) AS part FROM every WINDOW o AS (PARTITION BY list))
    SELECT id, round(sum(part), 6) AS score FROM z GROUP BY id
""")
def hybrid_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.weighted_sum(two_lists(spark, sf_dir), {"keyword": 0.4, "vector": 0.4, "exact": 0.2}, ["query_id", "id"])
    return rounded(fused.select("id", "score"), "score")


@query(f"""
    {_TWO_LISTS}
    SELECT id, round(coalesce(v.score, 0) * 0.6 + coalesce(k.score, 0) * 0.4, 6) AS score
    FROM vector v FULL OUTER JOIN keyword k USING (id)
""")
def two_list_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = two_lists(spark, sf_dir)
    both = fusion.two_list_combine(hits.filter("list = 'vector'"), hits.filter("list = 'keyword'"), 0.6, ["query_id", "id"])
    return rounded(both.select("id", "score"), "score")


def _staged(hits: DataFrame) -> DataFrame:
    """Stages in the order of the intent to debug: keyword, then vector."""
    stage = F.when(F.col("list") == fusion.STAGES["debug"][0], 0).otherwise(1)
    return hits.withColumn("stage", stage)


_RRF = f"""
    {_TWO_LISTS},
    every AS (SELECT 0 AS stage, 1.0 AS w, id, score FROM keyword UNION ALL SELECT 1, 0.8, id, score FROM vector),
    place AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY score DESC, id) - 1 AS r, max(score) OVER (PARTITION BY stage) AS best FROM every),
    fused AS (SELECT id, sum(w * (0.7 / (61 + r) + 0.3 * CASE WHEN best > 0 THEN score / best ELSE 0 END)) AS score FROM place GROUP BY id)"""


@query(f"{_RRF} SELECT id, round(score, 6) AS score FROM fused")
def rrf_weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.reciprocal_rank_fusion(_staged(two_lists(spark, sf_dir))).select("id", "score"), "score")


@query(f"""
    {_TWO_LISTS},
    every AS (SELECT 0 AS stage, id, score FROM keyword UNION ALL SELECT 1, id, score FROM vector)
    SELECT CAST(stage AS BIGINT) AS stage, id, place FROM (SELECT *, row_number() OVER (ORDER BY stage, round(score, 9) DESC, id) AS place FROM every) WHERE place <= 17
""")
def stage_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _staged(two_lists(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return fusion.prune_stages(hits).select(F.col("stage").cast("long").alias("stage"), "id", "place")


@query("""
    SELECT source AS query_id, doc_id, cost, CAST(used AS BIGINT) AS used FROM (
        SELECT source, doc_id, cost, sum(cost) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS used
        FROM (SELECT *, greatest(1, length(coalesce(text, '')) // 4) AS cost FROM documents)
    ) WHERE used <= 3500
""")
def context_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each source fits a budget of 3500 tokens, shortest first."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "query_id")
    return fusion.within_budget(docs, 3500, "text", F.col("n_chars"), F.col("doc_id")).select("query_id", "doc_id", "cost", "used")


@query("""
    SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))
""")
def dedup_normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.dedup_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", F.col("doc_id")).select("doc_id")


@query("""
    SELECT source, lang, doc_id, n_chars FROM (
        SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents
    ) WHERE r = 1
""")
def dedup_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return fusion.keep_max(docs, ["source", "lang"], F.desc("n_chars"), F.col("doc_id"))


_RANK = """
    WITH hit AS (
        SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic,
               min(n_chars) OVER () AS low, max(n_chars) OVER () AS high
        FROM documents d LEFT JOIN labels l USING (doc_id)
    ),
    f AS (
        SELECT doc_id,
               CASE WHEN high > low THEN (n_chars - low) / (high - low) ELSE 0.5 END AS relevance,
               CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END AS overlap,
               coalesce(quality, 0.3) AS q, CASE WHEN quality IS NULL THEN 0.3 ELSE 0.8 END AS q_conf,
               CASE WHEN lang = 'en' THEN ln(1.4) / ln(5) ELSE 0.0 END AS near
        FROM hit
    ),
    s AS (
        SELECT doc_id, (0.30 * relevance + 0.15 * 0.3 * 0 + 0.15 * overlap + 0.05 * 0 + 0.10 * near + 0.15 * 0.5 + 0.05 * q * q_conf + 0.05 * 0.5)
                       / (0.30 + 0.15 * 0.3 + 0.15 + 0.05 + 0.10 + 0.15 + 0.05 * q_conf + 0.05) AS score
        FROM f
    )
"""


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the eight factors: length as relevance, the language as context, the label as quality."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source"), table(spark, sf_dir, "labels")
    bounds = docs.agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high")).first()
    hit = docs.join(labels, "doc_id", "left")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    none, no = F.lit(None).cast("double"), F.lit(False)
    empty = F.array().cast("array<string>")
    return hit.select(
        "doc_id",
        ranking.factor(fn.unit_range(F.col("n_chars").cast("double"), F.lit(float(bounds["low"] or 0)), F.lit(float(bounds["high"] or 0))), 1.0).alias("text_relevance"),
        ranking.semantic_similarity(none, none, none, F.lit(""), F.lit("")).alias("semantic_similarity"),
        ranking.factor(ranking.context_overlap(empty, empty, empty, empty, no, english), 1.0).alias("context_overlap"),
        ranking.factor(F.lit(0.0), 1.0).alias("import_similarity"),
        ranking.factor(fn.log_damped(fn.path_proximity(F.lit("here/a"), F.col("source"), no, english)), 1.0).alias("proximity_score"),
        ranking.factor(F.lit(0.5), 1.0).alias("recency_score"),
        ranking.quality(F.col("quality").cast("double"), none, none, no, no).alias("quality_score"),
        ranking.factor(F.lit(0.5), 1.0).alias("pattern_match"),
    ).select("*", ranking.weighted_score(F.lit("debug")).alias("score"))


@query(f"{_RANK} SELECT doc_id, round(score, 6) AS score FROM s")
def rank_weighted_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranked_documents(spark, sf_dir).select("doc_id", "score"), "score")


@query(f"""
    {_RANK},
    b AS (SELECT round(score, 4) AS r, score FROM s),
    ties AS (SELECT count(*) AS n FROM b GROUP BY r)
    SELECT count(*) AS total_results, count(*) FILTER (score > 0.5) AS filtered_count, round(avg(score), 6) AS average_score,
           round(var_pop(score), 6) AS score_variance, (SELECT count(*) FROM ties WHERE n > 1) AS tie_count,
           count(*) FILTER (score < 0.2) AS bucket_0, count(*) FILTER (score >= 0.2 AND score < 0.4) AS bucket_1,
           count(*) FILTER (score >= 0.4 AND score < 0.6) AS bucket_2, count(*) FILTER (score >= 0.6 AND score < 0.8) AS bucket_3,
           count(*) FILTER (score >= 0.8) AS bucket_4
    FROM b
""")
def rank_metrics_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.metrics(ranked_documents(spark, sf_dir)), "average_score", "score_variance")


@query()
def rank_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(spark, sf_dir).select("doc_id", ranking.explanation(F.lit("debug")).alias("explanation"))


@query("""
    SELECT conv_id, turn, round(len(list_intersect(w, b)) / len(list_distinct(list_concat(w, b))), 6) AS similarity FROM (
        SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (
            SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]') AND x NOT IN
                ('the', 'is', 'at', 'which', 'on', 'and', 'a', 'an', 'as', 'by', 'for', 'if', 'in', 'it', 'of', 'or', 'to'))) AS w FROM conversations
        )
    ) WHERE b IS NOT NULL AND len(w) + len(b) > 0
""")
def jaccard_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword overlap of each turn with the one before."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", fn.keywords(F.col("text")).alias("w"))
    before = turns.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter(F.col("b").isNotNull() & (F.size("w") + F.size("b") > 0))
    return rounded(before.select("conv_id", "turn", fn.jaccard(F.col("w"), F.col("b")).alias("similarity")), "similarity")


@query("""
    WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
    SELECT p.page_id, round(CASE WHEN b > 0 THEN least(1, ln(1 + 4 * b) / ln(5)) ELSE 0 END, 6) AS proximity FROM (
        SELECT p.page_id, CASE
            WHEN p.path = q.path THEN 1.0
            WHEN string_split(p.path, '/')[:-2] = string_split(q.path, '/')[:-2] THEN 0.7
            WHEN len(string_split(p.path, '/')) > 2 AND len(string_split(q.path, '/')) > 2
                 AND string_split(p.path, '/')[:-3] = string_split(q.path, '/')[:-3] THEN 0.5
            ELSE 0.1 END AS b
        FROM p, (SELECT path FROM p WHERE page_id = 0) q
    ) p
""")
def path_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    here = pages.filter("page_id = 0").select("path").first()
    base = fn.path_proximity(F.lit(here["path"] if here else ""), F.col("path"), F.lit(False), F.lit(True))
    return rounded(pages.select("page_id", fn.log_damped(base).alias("proximity")), "proximity")


@query("""
    WITH w(factor, weight) AS (VALUES ('text_relevance', 0.30), ('semantic_similarity', 0.15), ('context_overlap', 0.15), ('import_similarity', 0.05),
        ('proximity_score', 0.10), ('recency_score', 0.15), ('quality_score', 0.05), ('pattern_match', 0.05)),
    s AS (SELECT avg(quality) - 0.5 AS shift FROM labels),
    held AS (SELECT factor, greatest(0.05, least(0.5, weight + CASE WHEN factor = 'quality_score' THEN shift ELSE 0 END)) AS weight FROM w, s)
    SELECT factor, round(weight / sum(weight) OVER (), 6) AS weight FROM held
""")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of quality moves with the mean label; weights stay within bounds and add up to 1."""
    shift = (table(spark, sf_dir, "labels").agg(F.avg("quality")).first()[0] or 0.5) - 0.5
    adjusted = ranking.weights_table(spark, {"debug": {"quality_score": shift}}).filter("intent = 'debug'")
    return rounded(adjusted.select("factor", "weight"), "weight")
