"""A store of vectors by the digest of the text they were made of, with expiry; looked up without a shuffle."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "made_at timestamp, folder string"
ROWS = "digest string, vector array<double>"


def digest(text: Column, context: Column | None = None) -> Column:
    """SHA-256 of a text and its context; null for null and blank texts, which have no vector."""
    whole = text if context is None else F.concat(text, F.coalesce(context, F.lit("")))
    return F.when(F.trim(text) != "", F.sha2(whole, 256))


def by_bucket(spark: SparkSession, path: str, ddl: str, key: str, buckets: int, rows: DataFrame | None = None) -> DataFrame:
    """The files of ``path`` as a table that is bucketed by ``key``; ``rows`` are written there first, where they lie.

    Spark knows bucketing by a catalogue entry only, which is gone again when
    this returns, also if it fails.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    try:
        if rows is not None:
            rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
        else:
            spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@dataclass
class VectorStore:
    """Vectors in a folder: each put() adds a part, bucketed by digest, with the time it was made."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], LOG)
            raise

    def put(self, vectors: DataFrame, made_at: str) -> None:
        """Add ``vectors`` (digest, vector). The part counts once the log has it. Rows without digest or vector are left out; of a repeated digest the smallest vector stays."""
        folder = f"part-{uuid.uuid4().hex}"
        rows = vectors.filter("digest is not null and vector is not null").groupBy("digest").agg(F.min("vector").alias("vector"))
        by_bucket(self.spark, f"{self.path}/{folder}", ROWS, "digest", self.buckets, rows)
        self.spark.sql(f"SELECT timestamp'{made_at}' AS made_at, '{folder}' AS folder").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def parts(self) -> list[tuple[object, DataFrame]]:
        """(made_at, part), the newest first."""
        rows = sorted(self.log().collect(), key=lambda r: (r["made_at"], r["folder"]), reverse=True)  # a row for each put
        return [(r["made_at"], by_bucket(self.spark, f"{self.path}/{r['folder']}", ROWS, "digest", self.buckets)) for r in rows]

    def requests(self, docs: DataFrame, key: str, text: Column, context: Column | None = None) -> DataFrame:
        """key and digest of the documents, bucketed like the store."""
        rows = docs.select(F.col(key).alias("key"), digest(text, context).alias("digest"))
        return by_bucket(self.spark, f"{self.path}/asked-{uuid.uuid4().hex}", "key long, digest string", "digest", self.buckets, rows)

    def looked_up(self, asked: DataFrame, as_of: str, days: int) -> DataFrame:
        """key, digest, state and vector for requests(): "hit", "expired" (made more than ``days`` before ``as_of``), "missing", or "blank".

        Both sides lie in the same buckets, so the joins need no exchange.
        """
        found = asked.withColumns({"vector": F.lit(None).cast("array<double>"), "made_at": F.lit(None).cast("timestamp")})
        for made_at, part in self.parts():
            own = part.select("digest", F.col("vector").alias("_v"))
            found = found.join(own.hint("merge"), "digest", "left").select("key", "digest", F.coalesce("vector", "_v").alias("vector"), F.coalesce("made_at", F.when(F.col("_v").isNotNull(), F.lit(made_at))).alias("made_at"))
        fresh = F.col("made_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
        state = F.when(F.col("digest").isNull(), "blank").when(F.col("made_at").isNull(), "missing").when(fresh, "hit").otherwise("expired")
        return found.select("key", "digest", state.alias("state"), F.when(fresh, F.col("vector")).alias("vector"))

    def to_make(self, asked: DataFrame, as_of: str, days: int) -> DataFrame:
        """digest of the texts that need a vector, each once, and how many documents wait for it."""
        return self.looked_up(asked, as_of, days).filter(F.col("state").isin("missing", "expired")).groupBy("digest").agg(F.count(F.lit(1)).alias("waiting"))
