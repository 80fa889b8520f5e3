"""Vectors kept by the texts they were made of; document i is taken to have vector i."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans.registry import query, table
from loomquery.sources.stored import shared_dir
from loomquery.sources.vectors import VectorStore, digest

AS_OF = "2024-02-10 00:00:00"
#: Day of a put, and which documents it made vectors of.
PUTS = [("2024-01-01 00:00:00", 3), ("2024-01-20 00:00:00", 5)]
DAYS = 30

_STATES = """
    d AS (SELECT doc_id, text, CASE WHEN trim(text, ' ') <> '' THEN sha256(text) END AS digest FROM documents),
    made AS (SELECT digest, max(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END) AS made FROM d JOIN embeddings ON vec_id = doc_id WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 GROUP BY digest),
    s AS (SELECT doc_id, digest, CASE WHEN digest IS NULL THEN 'blank' WHEN made IS NULL THEN 'missing' WHEN made = 2 THEN 'hit' ELSE 'expired' END AS state FROM d LEFT JOIN made USING (digest))"""


def store(spark: SparkSession, sf_dir: str) -> VectorStore:
    kept = VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", 16)
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    for day, of in PUTS:
        made = docs.filter(F.col("doc_id") % of == 0).join(vectors, F.col("doc_id") == F.col("vec_id"))
        kept.put(made.select(digest(F.col("text")).alias("digest"), F.col("embedding").cast("array<double>").alias("vector")), day)
    return kept


@query(f"WITH {_STATES} SELECT doc_id, state FROM s")
def vector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's vector is there, has expired or has to be made; copies share one."""
    kept = store(spark, sf_dir)
    asked = kept.requests(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return kept.looked_up(asked, AS_OF, DAYS).select(F.col("key").alias("doc_id"), "state")


@query(f"WITH {_STATES} SELECT digest, count(*) AS waiting FROM s WHERE state IN ('missing', 'expired') GROUP BY digest")
def vectors_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that need a vector, each once."""
    kept = store(spark, sf_dir)
    return kept.to_make(kept.requests(table(spark, sf_dir, "documents"), "doc_id", F.col("text")), AS_OF, DAYS)
