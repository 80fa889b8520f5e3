"""Small state tables kept as numbered snapshots: batches count once, earlier states can be read and brought back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "version long, batch string, kind string, source long, folder string"


@dataclass
class Versions:
    """A table in a folder: ``data`` has snapshots, ``log`` a row for each version that says which snapshot it is.

    A version counts once its log row is there; a run that breaks off before
    leaves an unused snapshot. One writer at a time is assumed, as a streaming
    query is one.
    """

    spark: SparkSession
    path: str

    def log(self) -> DataFrame:
        """version, batch, kind ("batch" or "rollback"), source (the version that a rollback brought back), folder."""
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], LOG)
            raise

    def last(self) -> int:
        """The last version, 0 if there is none."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version``, by default the last one."""
        wanted = self.last() if version is None else version
        row = self.log().filter(F.col("version") == wanted).first()
        if row is None:
            raise ValueError(f"there is no version {wanted}")
        return self.spark.read.parquet(f"{self.path}/{row['folder']}")

    def has(self, batch: str) -> bool:
        return self.log().filter(F.col("batch") == batch).head() is not None

    def _record(self, batch: str | None, kind: str, source: int | None, folder: str) -> int:
        version = self.last() + 1
        self.spark.createDataFrame([(version, batch, kind, source, folder)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def append(self, table: DataFrame | Callable[[], DataFrame], batch: str) -> int:
        """A new version from ``table``; nothing happens if a version of this batch is there. Returns the batch's version."""
        row = self.log().filter(F.col("batch") == batch).first()
        if row is not None:
            return row["version"]
        folder = f"data/{uuid.uuid4().hex}"
        (table() if callable(table) else table).write.parquet(f"{self.path}/{folder}")
        return self._record(batch, "batch", None, folder)

    def rollback(self, version: int) -> int:
        """A new version that is the snapshot of ``version`` again; those between stay readable."""
        row = self.log().filter(F.col("version") == version).first()
        if row is None:
            raise ValueError(f"there is no version {version}")
        return self._record(None, "rollback", version, row["folder"])
