"""Retrieval queries: documents stand for the chunk index, source for the repository, lang for the language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomquery.functions.text import tokens
from loomquery.operators import filters, retrieval
from loomquery.plans.registry import query, rounded, table

#: The queries asked of the corpus: (number, text).
ASKED = [(1, "the of with license"), (2, "und der version"), (3, "apache license version")]
VARIANTS = [(1, 0, "license version"), (1, 1, "licensed under version"), (1, 2, "the license")]


def asked(spark: SparkSession, rows=ASKED, names: str = "query_id", variant: bool = False) -> DataFrame:
    fields = [("query_id", "long"), ("variant", "long"), ("text", "string")] if variant else [("query_id", "long"), ("text", "string")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows])))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def bm25_sql(rows: str, key: str = "query_id") -> str:
    """CTEs up to ``scored``: the key, doc_id and score of every hit."""
    return f"""
        doc AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS words FROM documents),
        stats AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM doc),
        asked AS (SELECT DISTINCT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM (VALUES {rows})),
        tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM doc)
               WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, dl, term),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        scored AS (
            SELECT {key}, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
            FROM asked JOIN df USING (term) JOIN tf USING (term), stats GROUP BY {key}, doc_id
        )"""


def _headline_sql(text: str) -> str:
    return f"coalesce(left(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 60), '')"


@query(f"""
    WITH {bm25_sql(_values(ASKED)).replace("(VALUES " + _values(ASKED) + ")", "(VALUES " + _values(ASKED) + ") AS v(query_id, text)")}
    SELECT CAST(query_id AS BIGINT) AS query_id, rank, doc_id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored
    ) WHERE rank <= 10
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.bm25(table(spark, sf_dir, "documents"), asked(spark))
    best = retrieval.top_per_query(hits, 10, F.round("score", 9).desc(), F.col("id"))
    return rounded(best.select("query_id", "rank", F.col("id").alias("doc_id"), "score"), "score")


_VARIANT_SQL = bm25_sql(_values(VARIANTS), "variant").replace("(VALUES " + _values(VARIANTS) + ")", "(VALUES " + _values(VARIANTS) + ") AS v(query_id, variant, text)")


@query(f"""
    WITH {_VARIANT_SQL},
    first AS (SELECT doc_id, arg_min(score, variant) AS score, CAST(min(variant) AS BIGINT) AS variant FROM scored GROUP BY doc_id)
    SELECT doc_id, variant, round(score, 6) AS score, rank FROM (
        SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM first
    ) WHERE rank <= 50
""")
def bm25_multi_variant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three wordings of one query; a document found by several keeps its hit of the first."""
    variants = asked(spark, VARIANTS, variant=True).select(F.col("variant").alias("query_id"), "text")
    hits = retrieval.bm25(table(spark, sf_dir, "documents"), variants)
    first = retrieval.variants_union(hits.select(F.lit(1).alias("query_id"), F.col("query_id").alias("variant"), "id", "score"))
    best = retrieval.top_per_query(first, 50, F.round("score", 9).desc(), F.col("id"))
    return rounded(best.select(F.col("id").alias("doc_id"), "variant", "score", "rank"), "score")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'License') AND contains(text, 'Version 2.0')")
def exact_terms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(filters.exact_terms(["License", "Version 2.0"], [F.col("text")])).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND NOT list_has_any(regexp_extract_all(lower(text), '[a-z0-9_]+'), ['the', 'der'])")
def exclude_terms_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(filters.exclude_terms(["the", "der"], F.col("text"))).select("doc_id")


@query("""
    SELECT doc_id FROM documents
    WHERE source = 'src1' AND lang = 'en' AND contains(text, 'the')
      AND NOT list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), 'und')
""")
def filter_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equalities reach the scan; text predicates are left for the rows that remain."""
    where = filters.combine(filters.equals("source", "src1"), filters.equals("lang", "en"), filters.equals("framework", None), filters.exact_terms(["the"], [F.col("text")]), filters.exclude_terms(["und"], F.col("text")))
    return table(spark, sf_dir, "documents").filter(where).select("doc_id")


@query("SELECT count(*) AS n FROM documents WHERE FALSE")
def unsafe_term_matches_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(filters.exact_terms(["a or (b"], [F.col("text")])).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, source FROM documents WHERE starts_with(lower(source), 'src1') AND length(trim(coalesce(text, ''))) > 0")
def repository_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.filter(filters.repository_prefix(F.col("source"), "SRC1") & filters.not_blank(F.col("text"))).select("doc_id", "source")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, value LIMIT 20")
def facet_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.facets(table(spark, sf_dir, "documents"), "lang")


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 20")
def facet_source_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.facets(table(spark, sf_dir, "documents"), "source", 20)


@query("""
    SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
""")
def index_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.report(table(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM conversations) GROUP BY token")
def analyze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _cosine_sql(where: str, which: str = "q.vec_id % 100 = 0") -> str:
    return f"""
        WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        p AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(c.e, q.e) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE {which} {where}
        )
        SELECT query_id, vec_id, rank, round(score, 6) AS score, round(1 / (2 - score), 6) AS service_score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM p
        ) WHERE rank <= 10
    """


def _cosine(vectors: DataFrame, asked_vectors: DataFrame, which: str = "vec_id % 100 = 0") -> DataFrame:
    queries = asked_vectors.filter(which).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieval.cosine_top_k(vectors, queries, 11).filter("id <> query_id").drop("rank")
    best = retrieval.top_per_query(near, 10, F.round("score", 9).desc(), F.col("id"))
    return rounded(best.select("query_id", F.col("id").alias("vec_id"), "rank", "score", retrieval.service_score(F.col("score")).alias("service_score")), "score", "service_score")


@query(_cosine_sql(""))
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector is a query: their number grows with the table."""
    v = table(spark, sf_dir, "embeddings")
    return _cosine(v, v)


@query(_cosine_sql("AND c.label = 3"))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stands below the distance, so that only rows that pass it are compared."""
    v = table(spark, sf_dir, "embeddings")
    return _cosine(v.filter("label = 3"), v)


@query(_cosine_sql(""))
def vector_topk_cosine_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as vector_topk_cosine, under its earlier name."""
    return vector_topk_cosine(spark, sf_dir)


@query(_cosine_sql("AND c.label = 3"))
def vector_topk_filtered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as vector_topk_filtered, under its earlier name."""
    return vector_topk_filtered(spark, sf_dir)


@query("""
    SELECT doc_id, lang, position FROM (
        SELECT doc_id, lang, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents WHERE lang IN ('de', 'fr')
    ) WHERE position >= 20 AND position < 40
""")
def basic_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, order, skip 20, take 20: a top-k of 40 rows, numbered afterwards."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang").isin("de", "fr"))
    order = [F.desc("n_chars"), F.col("doc_id")]
    page = docs.select("doc_id", "lang", "n_chars").orderBy(*order).limit(40)
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long") - 1).filter("position >= 20").select("doc_id", "lang", "position")
