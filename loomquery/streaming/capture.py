"""Capture of events with constraints: one pass tells accepted rows from rejected ones and counts both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with problems: the names of the rules that don't hold, in the rules' order. A rule that can't be told (null) doesn't hold."""
    failed = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return rows.withColumn("problems", F.filter(failed, lambda x: x.isNotNull()))


def counted(rows: DataFrame, rules: dict[str, Column], name: str = "capture") -> DataFrame:
    """checked() rows that count themselves on the way: all, accepted, and those that break each rule; see observed()."""
    found = checked(rows, rules)
    return found.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("problems") == 0).alias("accepted"), *[F.count_if(F.array_contains("problems", rule)).alias(rule) for rule in rules])


def keeper(folder: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes accepted and rejected rows of a batch to the folder of that batch, so that a repeated batch replaces itself."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("accepted", F.size("problems") == 0).write.mode("overwrite").partitionBy("accepted").parquet(f"{folder}/batch={number}")

    return keep


def kept(spark: SparkSession, folder: str, accepted: bool) -> DataFrame:
    """The accepted rows, or the rejected ones with their problems; the others' files are not read."""
    found = spark.read.parquet(folder).filter(F.col("accepted") == accepted).drop("batch", "accepted")
    return found.drop("problems") if accepted else found


def observed(query: StreamingQuery, name: str = "capture") -> dict[str, int]:
    """The sums of what counted() has seen over a query's triggers."""
    total: dict[str, int] = {}
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        if row is not None:
            for field, value in row.asDict().items():
                total[field] = total.get(field, 0) + (value or 0)
    return total
