"""Texts that are alike: the most similar ones, and values that differ in notation only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.canonical import canonical
from loomquery.operators.similar import most_similar
from loomquery.plans.registry import query, rounded, table


@query("""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) ELSE [array_to_string(words, ' ')] END)) AS s
          FROM w WHERE len(words) > 0),
    r AS (SELECT s, min(doc_id) AS id FROM s GROUP BY s),
    e AS MATERIALIZED (SELECT id, len(s) AS m, unnest(s) AS shingle FROM r),
    q AS (SELECT doc_id AS query_key, id FROM s JOIN r USING (s) WHERE doc_id % 100 = 0),
    c AS (SELECT a.id, b.id AS other, any_value(a.m) AS n, any_value(b.m) AS m, count(*) AS common FROM e a JOIN e b USING (shingle)
          WHERE a.id IN (SELECT id FROM q) AND a.id <> b.id GROUP BY a.id, b.id),
    t AS (SELECT id, other, common / (n + m - common) AS similarity FROM c)
    SELECT query_key, rank, other AS other_key, round(similarity, 6) AS similarity
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM t) JOIN q USING (id) WHERE rank <= 10
""")
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten texts most similar to each of every hundredth document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rounded(most_similar(docs, F.col("doc_id") % 100 == 0, 10, "doc_id", "text"), "similarity")


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, text: each event's properties with its kind, in one of four notations, one of them broken."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    forms = [F.concat(F.lit('{"k":'), k, F.lit(',"type":"'), kind, F.lit('"}')), F.concat(F.lit('{ "type" : "'), kind, F.lit('",\n  "k" : '), k, F.lit(" }")), F.concat(F.lit('\t{"type":"'), kind, F.lit('", "k":'), k, F.lit("}\n"))]
    form = F.when(F.col("event_id") % 4 == 0, forms[0]).when(F.col("event_id") % 4 == 1, forms[1]).when(F.col("event_id") % 4 == 2, forms[2]).otherwise(F.concat(F.lit(" {k "), k, F.lit("\n\n ")))
    return table(spark, sf_dir, "events").select("event_id", form.alias("text"))


@query("""
    WITH e AS (SELECT event_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events),
    c AS (SELECT event_id, event_id % 4 AS form, CASE WHEN event_id % 4 < 3 THEN '{"k":' || k || ',"type":"' || event_type || '"}' ELSE '{k ' || k END AS canonical FROM e)
    SELECT canonical, count(*) AS n, count(DISTINCT form) AS notations, min(event_id) AS first_id FROM c GROUP BY canonical
""")
def equivalent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are equal whatever their notation: one row for each, with how many notations it has."""
    forms = written(spark, sf_dir).select("event_id", "text", canonical(F.col("text"), F.lit(".json")).alias("canonical"))
    return forms.groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("notations"), F.min("event_id").alias("first_id"))
