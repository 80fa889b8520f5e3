"""What to do about indexes: each pair of a source and a language is taken for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import advice
from loomquery.plans.registry import query, table

#: As the rules of real indexes, at the size of the given tables.
SMALL_HINTS = [
    advice.Rule("documents > 50", "medium", "performance", "'many documents'"),
    advice.Rule("bytes > 100000", "medium", "storage", "concat('size ', bytes)"),
    advice.Rule("bytes > 200000", "high", "storage", "concat('size ', bytes, ', near the limit')"),
    advice.Rule("longest > 20000", "low", "text", "concat('longest text ', longest)"),
]

_FIGURES = """
    d AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, n_chars FROM documents),
    i AS (SELECT s.source, l.lang FROM (SELECT DISTINCT source FROM d) s, (SELECT DISTINCT lang FROM d) l),
    f AS (SELECT i.source, i.lang, count(d.source) AS documents, CAST(coalesce(sum(octet_length(encode(d.text))), 0) AS BIGINT) AS bytes, coalesce(max(length(d.text)), 0) AS longest,
                 count(*) FILTER (d.source IS NOT NULL AND (d.text IS NULL OR trim(d.text, ' ') = '')) AS invalid, count(*) FILTER (length(d.text) <> d.n_chars OR length(d.text) > 32000) AS warnings
          FROM i LEFT JOIN d ON d.source = i.source AND d.lang = i.lang GROUP BY i.source, i.lang)"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, lang, documents, bytes, longest, invalid, warnings: one aggregation; pairs without documents too."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text", "n_chars")
    size = F.length("text")
    found = docs.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(size), F.lit(0)).alias("longest"),
        F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("invalid"),
        F.count_if((size != F.col("n_chars")) | (size > 32000)).alias("warnings"),
    )
    # The names come from the aggregated rows: two short lists.
    names = found.agg(F.collect_set("source").alias("s"), F.collect_set("lang").alias("l"))
    every = names.select(F.explode("s").alias("source"), "l").select("source", F.explode("l").alias("lang"))
    return every.join(found, ["source", "lang"], "left").na.fill(0)


@query(f"""
    WITH {_FIGURES},
    r AS (
        SELECT source, lang, 0 AS nth, 'high' AS priority, 'drop-rebuild' AS action, 'Schema validation failed: ' || invalid || ' rows' AS reason FROM f WHERE invalid > 0
        UNION ALL SELECT source, lang, 1, 'medium', 'schema-update', 'Schema warnings: ' || warnings || ' rows' FROM f WHERE warnings > 0
        UNION ALL SELECT source, lang, 2, 'high', 'repository', 'Index is empty' FROM f WHERE documents = 0
        UNION ALL SELECT source, lang, 3, 'low', 'optimize', 'Index size exceeds 10GB, consider optimization' FROM f WHERE bytes > 10737418240
    )
    SELECT f.source, f.lang, documents, coalesce(bool_or(priority = 'high'), false) AS needs_reindex, coalesce(string_agg(action || ': ' || reason, '; ' ORDER BY nth), '') AS advice
    FROM f LEFT JOIN r ON r.source = f.source AND r.lang = f.lang GROUP BY ALL
""")
def reindex_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each index should be built anew, and all that speaks for it."""
    found = advice.plan(figures(spark, sf_dir))
    return found.select("source", "lang", "documents", "needs_reindex", F.array_join(F.transform("advice", lambda a: F.concat(a["action"], F.lit(": "), a["reason"])), "; ").alias("advice"))


@query(f"""
    WITH {_FIGURES}
    SELECT source, lang, 0 AS nth, 'medium' AS priority, 'performance' AS action, 'many documents' AS reason FROM f WHERE documents > 50
    UNION ALL SELECT source, lang, 1, 'medium', 'storage', 'size ' || bytes FROM f WHERE bytes > 100000
    UNION ALL SELECT source, lang, 2, 'high', 'storage', 'size ' || bytes || ', near the limit' FROM f WHERE bytes > 200000
    UNION ALL SELECT source, lang, 3, 'low', 'text', 'longest text ' || longest FROM f WHERE longest > 20000
""")
def index_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hint that holds for an index, a row each."""
    return advice.matches(figures(spark, sf_dir), SMALL_HINTS).select("source", "lang", F.inline("advice"))
