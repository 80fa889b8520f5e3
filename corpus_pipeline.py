"""A corpus preparation pipeline over ``documents``: five stages, each one operator of loomquery.llm.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of documents; the last returns the packing. Null texts have no language
and go in the first stage; repeated rows are exact copies and all but one go in
the third; an empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import langid, packing, quality
from loomquery.llm.common import cut
from loomquery.llm.exact_dedup import drop_copies, keep_rows, normal
from loomquery.llm.queries import GRADE, N_GRADES
from loomquery.llm.simhash import near_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a learned language; nothing labelled, nothing rejected.

    A document needs a letter, and a share of known n-grams not below the floor
    of its language (half the median of the labelled rows, or less). Filters and
    floors come from all labelled rows.
    """
    filters = langid.fit(docs, per_language=None)
    if not filters.langs:
        return docs
    told = cut(docs.withColumn("_told", langid.identify(docs, filters, share=True)), "language-told")  # written once: floors and filter read it
    floors = langid.floors_of(told.filter("text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("_told.share").alias("share")))
    least = F.create_map(*[F.lit(x) for pair in sorted(floors.items()) for x in pair])
    return told.filter((F.col("_told.lang") != langid.UNKNOWN) & (F.col("_told.share") >= least[F.col("_told.lang")])).drop("_told")


def grade_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that most likely have the best grade; nothing rated, nothing rejected."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), GRADE, N_GRADES)
    if model is None:
        return docs
    return docs.filter(quality.grade_texts(docs, model)["top_probability"] >= 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest doc_id of equal texts."""
    return drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of each near-duplicate group (of a repeated id, the text with the least digest)."""
    digest = F.sha2(normal(F.col("text")), 256)
    first = near_dedup(docs, mark=digest).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = first.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
    return keep_rows(docs, stay.select("row.doc_id", "row.mark", F.lit(1).alias("copies")), by=digest)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign what is left to bins."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_classifier", grade_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_bins),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
