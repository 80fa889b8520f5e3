"""A keyed table that takes change feeds: batches count once, order of arrival doesn't, and only touched parts are written anew."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

LOG = "version long, batch string, buckets array<int>, folder string"


@dataclass
class KeyedTable:
    """Rows by ``key`` in a folder, in ``buckets`` parts by the key's hash.

    ``columns`` (a DDL string) has the key, a long ``seq`` and a boolean
    ``deleted`` among others. Each merged batch writes the parts that it touches
    to a folder of its own and adds a row to the log; a part is where the last
    row of the log that names it says. One writer at a time is assumed, as a
    streaming query is one; a run that breaks off leaves files that nobody reads.
    """

    spark: SparkSession
    path: str
    key: str
    columns: str
    buckets: int = 64

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], LOG)
            raise

    def _rows(self, version: int | None, only: list[int] | None = None) -> DataFrame:
        """All rows with their bucket, deleted ones too."""
        place: dict[int, str] = {}
        for r in sorted(self.log().collect(), key=lambda r: r["version"]):  # a row for each batch
            if version is None or r["version"] <= version:
                place |= {b: r["folder"] for b in r["buckets"]}
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in sorted(place.items()) if only is None or b in only]
        schema = StructType.fromDDL(self.columns)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows that are there, by default as of the last version."""
        return self._rows(version).filter("not deleted")

    def merge(self, changes: DataFrame, batch: str) -> bool:
        """Take ``changes`` (the table's columns); False if the batch has had its version.

        Of a key's rows, in the table and in the batch, the one with the largest
        seq stays (of equal seq the one with the largest other columns), so that
        late changes are no matter. A deleted row keeps its key and seq for that
        reason. Changes without key or seq are left out.
        """
        log = self.log()
        if log.filter(F.col("batch") == batch).head() is not None:
            return False
        version = (log.agg(F.max("version")).first()[0] or 0) + 1
        schema = StructType.fromDDL(self.columns)
        others = [f.name for f in schema if f.name not in (self.key, "seq", "deleted")]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

        def last(rows: DataFrame) -> DataFrame:
            whole = F.struct("seq", "deleted", *others)
            return rows.groupBy(self.key).agg(F.max(whole).alias("r")).select(self.key, "r.*")

        known = changes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn("deleted", F.coalesce("deleted", F.lit(False))).filter(F.col(self.key).isNotNull() & F.col("seq").isNotNull())
        newest = last(known)
        touched = sorted(r[0] for r in newest.select(bucket).distinct().collect())  # a number for each part
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            merged = last(self._rows(None, touched).select(*newest.columns).unionByName(newest))
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        else:
            folder = ""
        self.spark.createDataFrame([(version, batch, touched, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True

    def merger(self, name: str = "feed") -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch."""

        def merge(changes: DataFrame, number: int) -> None:
            self.merge(changes, f"{name}-{number}")

        return merge
