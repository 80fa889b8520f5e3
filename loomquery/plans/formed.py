"""Forms of hits, graphs and vectors: defaults, orders, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import explain, filters, graph, quality, ranking, shaping
from loomquery.plans.code import _EDGES, edges
from loomquery.plans.registry import query, rounded, table


@query("""
    WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 <> 1 THEN 'd' || doc_id END AS id, source AS file_path, CASE WHEN doc_id % 4 > 0 THEN doc_id % 3 - 1 END AS start_line,
                      CASE WHEN doc_id % 6 > 0 THEN doc_id % 7 END AS end_line, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 10 - 2) / 8 END AS relevance FROM documents),
    s AS (SELECT *, greatest(1, coalesce(start_line, 1)) AS first_line FROM h)
    SELECT doc_id, coalesce(nullif(id, ''), concat_ws(':', file_path, first_line)) AS id, coalesce(file_path, '') AS file_path, first_line AS start_line,
           greatest(first_line, coalesce(end_line, first_line)) AS end_line, round(greatest(0, coalesce(relevance, 0)), 6) AS relevance FROM s
""")
def hit_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with fields missing here and there, and with all of them."""
    n = F.col("doc_id")
    hits = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(n % 5 == 0, "").when(n % 5 != 1, F.concat(F.lit("d"), n.cast("string"))).alias("id"),
        F.col("source").alias("file_path"),
        F.when(n % 4 > 0, n % 3 - 1).alias("start_line"),
        F.when(n % 6 > 0, n % 7).alias("end_line"),
        F.when(n % 9 > 0, (n % 10 - 2) / 8).alias("relevance"),
    )
    return rounded(shaping.consistent(hits), "relevance")


@query("""
    SELECT page_id, coalesce('Function: ' || nullif(f, ''), 'Class: ' || nullif(c, ''), nullif(h, ''), 'Code match') AS summary
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '/', 3) WHEN page_id % 3 = 1 THEN '' END AS f, CASE WHEN page_id % 2 = 0 THEN 'P' || page_id END AS c,
                 CASE WHEN page_id % 5 > 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS h FROM pages)
""")
def hit_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each hit is about, by the best that is known of it."""
    n = F.col("page_id")
    function = F.when(n % 3 == 0, F.split_part("url", F.lit("/"), F.lit(3))).when(n % 3 == 1, "")
    title = F.when(n % 5 > 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", explain.matched_summary(function, F.when(n % 2 == 0, F.concat(F.lit("P"), n.cast("string"))), title).alias("summary"))


@query("""
    WITH p AS (SELECT page_id, string_split(html, '</p>')[1:3] AS found FROM pages),
    h AS (SELECT page_id, list_filter(list_transform(found, lambda x: left(trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&nbsp;| ', ' ', 'g'), ' '), 200)), lambda x: length(trim(x, ' ')) > 0) AS h FROM p)
    SELECT page_id, unnest(h) AS highlight, generate_subscripts(h, 1) - 1 AS place FROM h
""")
def page_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three paragraphs of each page as highlights."""
    found = F.slice(F.split("html", "</p>", -1), 1, 3)
    each = table(spark, sf_dir, "pages").select("page_id", F.posexplode(fn.highlights(found)).alias("place", "highlight"))
    return each.select("page_id", "highlight", F.col("place").cast("long").alias("place"))


@query("""
    SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY (doc_id % 10) / 10 DESC, doc_id % 7 DESC, n_chars, source DESC NULLS LAST, doc_id) AS rank FROM documents
""")
def four_level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by score, score before ranking, length, path and id."""
    n = F.col("doc_id")
    scored = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), n.alias("id"), (n % 10 / 10).alias("score"), (n % 7).alias("original"), F.col("n_chars").alias("length"), F.col("source").alias("path"))
    return ranking.rank_order(scored).select("query_id", "id", "rank")


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '\\b(AND|OR|NOT)\\b|[{}\\[\\]();=<>]') OR length(text) > 500")
def lexical_only_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that are searched by their words alone."""
    return table(spark, sf_dir, "conversations").filter(filters.lexical_only(F.col("text"))).select("conv_id", "turn")


@query("SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CASE WHEN vec_id % 7 = 0 THEN 10 ELSE len(embedding) END END AS dimensions FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 7 = 0 OR len(embedding) <> 64")
def vectors_of_wrong_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that have to be made anew, with their dimensions; some are cut or taken away to have any."""
    n, v = F.col("vec_id"), F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(n % 11 == 0, None).when(n % 7 == 0, F.slice(v, 1, 10)).otherwise(v).alias("v"))
    return quality.needs_embedding(rows, "v", 64).select("vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dimensions"))


@query(f"""WITH {_EDGES} SELECT '  "' || src || '" -> "' || dst || '" [label="' || left(src, 1) || left(dst, 1) || '"];' AS line FROM e""")
def graph_as_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dot statement for each edge."""
    ends = edges(spark, sf_dir).select("src", "dst").distinct()
    return graph.as_dot(ends.withColumn("type", F.concat(F.substring("src", 1, 1), F.substring("dst", 1, 1))))


@query(f"""
    WITH {_EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT '{{"kind":"node","node":"' || node || '"}}' AS line FROM n UNION ALL SELECT '{{"kind":"edge","src":"' || src || '","dst":"' || dst || '"}}' FROM e
""")
def graph_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each node and edge."""
    ends = edges(spark, sf_dir).select("src", "dst").distinct()
    return graph.as_json(ends.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), ends)


@query("""
    SELECT l_orderkey, l_linenumber, round(least(1, l_quantity / 50 * CASE WHEN l_linenumber = 1 THEN 1.2 ELSE 1 END * CASE WHEN l_suppkey % 2 = 0 THEN 1.3 ELSE 1 END * CASE WHEN l_partkey % 3 = 0 THEN 0.8 ELSE 1 END), 6) AS score FROM lineitem
""")
def dependency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of orders as dependencies: first lines have the term, even suppliers are near, every third part is transitive."""
    base = F.col("l_quantity").cast("double") / 50
    score = graph.dependency_score(base, F.col("l_linenumber") == 1, F.col("l_suppkey") % 2 == 0, F.col("l_partkey") % 3 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))
