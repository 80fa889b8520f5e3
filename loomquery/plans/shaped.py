"""Result shaping over documents: n_chars as a share of 5000 stands for the relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import shaping
from loomquery.plans.registry import query, rounded, table

_SCORE = "least(1.0, n_chars / 5000.0)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 5000.0))


@query("""
    SELECT lang, doc_id, position, total, total > 15 AS has_more, CASE WHEN total > 15 THEN 15::BIGINT END AS next_skip FROM (
        SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS position, count(*) OVER (PARTITION BY lang) AS total FROM documents
    ) WHERE position > 5 AND position <= 15
""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of ten after a first one of five, for each language."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return shaping.page(docs, 10, 5, F.desc("n_chars"), F.col("doc_id"), query_col="lang").select("lang", "doc_id", "position", "total", "has_more", "next_skip")


@query(f"SELECT CASE WHEN s >= 0.9 THEN 'excellent' WHEN s >= 0.7 THEN 'good' WHEN s >= 0.5 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM (SELECT {_SCORE} AS s FROM documents) GROUP BY bucket")
def relevance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).groupBy(shaping.relevance_bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH h AS (SELECT source, doc_id, {_SCORE} AS s FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS place FROM h)
    SELECT source AS "group", count(*) AS n, array_to_string(list(doc_id ORDER BY place) FILTER (place <= 10), ',') AS best FROM r GROUP BY source
""")
def grouped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shaping.grouped(hits(spark, sf_dir), F.col("source"), F.col("score"), "doc_id")
    return found.select("group", "n", F.concat_ws(",", F.transform("best", lambda x: x.cast("string"))).alias("best"))


@query(f"""
    WITH h AS (SELECT source, {_SCORE} AS s FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY s DESC) AS place FROM h),
    m AS (SELECT source, avg(s) FILTER (place <= 5) AS mean, count(*) AS n FROM r GROUP BY source)
    SELECT source, round(least(1.0, mean * CASE WHEN n >= 10 THEN 1.2 WHEN n >= 5 THEN 1.0 ELSE 0.8 END), 6) AS confidence FROM m
""")
def response_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shaping.confidence(hits(spark, sf_dir), "score", "source"), "confidence")


@query("""
    WITH l AS (
        SELECT doc_id, source, n_chars,
               coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0 AND NOT regexp_matches(x, '^(#|//|/\\*|\\*)'))[1], '') AS h
        FROM documents
    )
    SELECT doc_id, concat_ws(':', source, '1') AS at, CASE WHEN length(h) > 120 THEN left(h, 120) || '…' ELSE h END AS headline, round(least(1.0, n_chars / 5000.0), 4) AS score,
           source || ':1 | ' || CASE WHEN length(h) > 57 THEN left(h, 57) || '…' ELSE h END || ' | ' || printf('%.2f', least(100, (n_chars + 25) // 50) / 100.0) AS line
    FROM l
""".replace(" AS at,", ' AS "at",'))
def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in one line and in compact form."""
    c, p = F.col("text"), F.col("source")
    return hits(spark, sf_dir).select("doc_id", shaping.compact(c, p, F.lit(1), F.col("score")).alias("x"), shaping.one_line(c, p, F.lit(1), F.col("score")).alias("line")).select("doc_id", "x.at", "x.headline", "x.score", "line")


@query("""
    SELECT page_id, to_base64(encode(url)) AS key, url AS decoded FROM pages
""")
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as legal keys, and back."""
    key = F.translate(F.base64(F.encode("url", "utf-8")), "\r\n", "")  # in one line: Spark breaks it after 76 characters
    pages = table(spark, sf_dir, "pages").select("page_id", key.alias("key"))
    return pages.withColumn("decoded", F.decode(F.unbase64("key"), "utf-8"))


@query("SELECT d.doc_id, d.source, b.item_id FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id")
def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One join in place of a lookup for each key."""
    keys = table(spark, sf_dir, "benchmark").select("item_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return keys.join(docs, keys["item_id"] == docs["doc_id"], "left").select("doc_id", "source", "item_id")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE strlen(text) > 5000")
def oversized_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text takes more than 5,000 bytes."""
    docs = table(spark, sf_dir, "documents").filter(F.octet_length("text") > 5000)
    return docs.select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<iframe.*?</iframe>', '', 'g'), '(?i)javascript:|\\bon\\w+\\s*=', '', 'g'), 10000) AS clean FROM pages")
def sanitised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.sanitised(F.col("html")).alias("clean"))
