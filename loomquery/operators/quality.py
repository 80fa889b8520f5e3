"""Data quality and health rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, total, present, empty, percent for each field, in one pass."""
    counts = [F.struct(F.lit(f).alias("field"), F.count(F.lit(1)).alias("total"), F.count(f).alias("present"), F.count_if(F.trim(F.col(f).cast("string")) == "").alias("empty")) for f in fields]
    found = docs.agg(F.array(*counts).alias("x")).select(F.inline("x"))
    return found.withColumn("percent", F.round(100 * F.col("present") / F.greatest(F.col("total"), F.lit(1)), 2))


def missing(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field: one row for every required field that a row lacks."""
    lacks = F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields])
    return docs.select(key, F.explode(F.filter(lacks, lambda x: x.isNotNull())).alias("field"))


def embedding_validity(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    v = F.col(vector)
    size = F.size(v)
    return vectors.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(v.isNotNull() & (size == dimension)).alias("valid"),
        F.count_if(v.isNotNull() & (size != dimension)).alias("invalid"),
        F.count_if(v.isNull()).alias("missing"),
    )


def needs_embedding(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    return vectors.filter(F.col(vector).isNull() | (F.size(vector) != dimension))


def health(runs: DataFrame, group: str, ok: Column) -> DataFrame:
    """group, runs, success_percent, status: below 70 critical, below 90 a warning."""
    out = runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs"), F.round(100 * F.avg(ok.cast("int")), 2).alias("success_percent"))
    return out.withColumn("status", F.when(F.col("success_percent") < 70, "critical").when(F.col("success_percent") < 90, "warning").otherwise("healthy"))


SEVERITY = ["healthy", "warning", "error", "critical"]


def worst_status(statuses: DataFrame, status: str) -> DataFrame:
    """One row: the worst status there is."""
    level = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col(status))
    return statuses.agg(F.max(level).alias("level")).select(F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.greatest(F.lit(1), F.coalesce(F.col("level"), F.lit(1))).cast("int")).alias("status"))


def schedule_advice(runs: DataFrame, group: str, order: list[Column], items: str, last: int = 20) -> DataFrame:
    """group, mean_items, advice from the last runs of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    mean = F.avg(items)
    out = runs.withColumn("_n", place).filter(F.col("_n") <= last).groupBy(group).agg(mean.alias("mean_items"))
    return out.withColumn("advice", F.when(F.col("mean_items") < 10, "less often").when(F.col("mean_items") > 1000, "more often").otherwise("keep"))


def status_rollup(runs: DataFrame, group: str, order: list[str], status: str) -> DataFrame:
    """status, n: how many groups have it last."""
    last = runs.groupBy(group).agg(F.max_by(status, F.struct(*order)).alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def field_differences(expected: DataFrame, actual: DataFrame, key: str = "field") -> DataFrame:
    """field, problem: what either side lacks."""
    lacking = expected.join(actual, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return lacking.unionByName(actual.join(expected, key, "left_anti").select(key, F.lit("unexpected").alias("problem")))
