"""Keyed tables: upsert, merge, delete, retention, incremental reads, reindexing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_ROW_BYTES = 1 << 20


def replace_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of those with their key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values where they are there, old ones elsewhere; unknown keys are added."""
    both = table.alias("o").join(new.alias("n"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in table.columns if c != key])


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is unknown stay."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def expired(table: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows older than ``days`` at ``as_of``; a plain range filter that reaches the scan."""
    return table.filter(F.col(ts) < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def since(table: DataFrame, column: str, high_water_mark, deleted: Column | None = None) -> DataFrame:
    """Rows above the mark, without those marked deleted."""
    found = table.filter(F.col(column) > F.lit(high_water_mark))
    return found if deleted is None else delete_where(found, deleted)


def reindex(source: DataFrame, transform=None, condition: Column | None = None) -> DataFrame:
    """A copy through an optional filter and DataFrame function; all rows are read, however many the function drops."""
    out = source if condition is None else source.filter(condition)
    return out if transform is None else out.transform(transform)


def clamp_rows(table: DataFrame, text: str, most: int = MAX_ROW_BYTES) -> DataFrame:
    """Rows whose JSON is larger than ``most`` bytes get their text cut in proportion, to 80 % of the room."""
    size = F.octet_length(F.to_json(F.struct("*")))
    room = (F.length(text) * F.lit(0.8 * most) / size).cast("int")
    return table.withColumn("truncated", size > most).withColumn(text, F.when(F.col("truncated"), F.substring(F.col(text), F.lit(1), room)).otherwise(F.col(text)))


def latest(table: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key and its last value."""
    return table.groupBy(key).agg(F.max_by(value, ts).alias(value))


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON-lines log; lines that aren't JSON are left out."""
    return spark.read.schema(StructType([*schema.fields]).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path).filter("_corrupt_record is null").drop("_corrupt_record")


def schema_backup(table: DataFrame) -> str:
    return table.schema.json()


def schema_restore(spark: SparkSession, text: str) -> DataFrame:
    import json

    return spark.createDataFrame([], StructType.fromJson(json.loads(text)))


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by repository and language, so that filters on them prune files.

    Rows are rebalanced by both: small groups share a task, and a repository
    that is too large for one is split over several, each with a file.
    """
    chunks.hint("rebalance", "repository", "language").write.mode(mode).partitionBy("repository", "language").parquet(path)
