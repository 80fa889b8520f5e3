"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import ascii_lower, cut, levels, partitions
from loomquery.sources.stored import shared_dir

KEY = ["digest", "n_bytes", "mark"]


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def sorted_runs(rows: DataFrame, n_buckets: int) -> DataFrame:
    """``rows`` written by the tasks that hold them, bucketed by run, and read again.

    A reader then knows that a run is whole in one partition, so that runs can
    be built without an exchange. The catalogue entry that bucketing needs is
    gone again when this returns; the files in the shared folder stay.
    """
    spark = rows.sparkSession
    name = f"runs_{uuid.uuid4().hex}"
    rows.write.format("parquet").bucketBy(n_buckets, "run").sortBy("run", *KEY).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", fan_in: int = 16, piece_rows: int = 1 << 20) -> DataFrame:
    """Group rows of equal text (equal after lower-casing A-Z) and choose one of each group.

    Every input partition becomes one run where it lies: its digests sorted and
    aggregated to one row each, without an exchange. Rounds then merge
    ``fan_in`` neighbouring runs (a fan_in of 2 is the binomial tree; a wider one
    only saves rounds): whole runs move to the run they are merged into, in
    pieces of the digest's range (of at most ``piece_rows`` rows, and enough of
    them to keep all partitions busy), and the rows of one digest leave as one row that holds the surviving identifier
    and the row count. A piece is partitioned and sorted once for a round, and
    merged in that order. So a digest has at most fan_in rows to merge at any
    level, however many copies it has, no task has a run of unbounded size, and
    no level sees texts. A merge compares the SHA-256 digest together with the
    byte length and an independent 64-bit hash, so that every retained
    identifier stands for a verified group. The survivors go back down the same
    tree: first to the runs, then inside each run to its rows, which spreads a
    hot group over all runs.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. ``keep`` is "largest" or "smallest" (by doc_id).

    Null text counts as empty. Null ids are allowed and lose against any other
    id. Rows that repeat an id and a text are one group, of which exactly one
    row is kept. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    norm = normal(F.col(text_col))
    sign = 1 if keep == "largest" else -1
    n_partitions = partitions(df.sparkSession)
    rows = sorted_runs(
        df.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("mark"),
            F.spark_partition_id().alias("run"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        n_partitions,
    )
    size = rows.agg(F.max("run").alias("last"), F.count(F.lit(1)).alias("n")).first()
    n_runs = (size["last"] or 0) + 1

    best = F.max(F.struct((F.col("doc_id") * sign).alias("order"), "row_no")).alias("best")
    runs = cut(rows.groupBy("run", *KEY).agg(best, F.count(F.lit(1)).alias("n")), "digest-runs")
    merged = runs
    for level in range(levels(n_runs, fan_in)):
        left = -(-n_runs // fan_in ** (level + 1))
        pieces = -(-max(size["n"] // piece_rows, 4 * n_partitions) // left)
        # The digest's first four bytes tell its place in the range of all digests.
        piece = F.floor(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") * pieces / 2**32).cast("int")
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .withColumn("piece", piece)
            .repartition(n_partitions, "run", "piece")
            .sortWithinPartitions("run", "piece", *KEY)
            .groupBy("run", "piece", *KEY)
            .agg(F.max("best").alias("best"), F.sum("n").alias("n"))
            .drop("piece")
        )
    root = merged.select(*KEY, F.col("best").alias("root"), F.col("n").alias("group_size"))
    per_run = runs.select("run", *KEY).join(root, KEY)
    return rows.join(per_run, ["run", *KEY]).select(
        "doc_id",
        (F.col("root.order") * sign).alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("root.row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, survivors: DataFrame, id_col: str = "doc_id", by: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that ``survivors`` names (columns doc_id, copies, and mark if ``by`` is given), with all columns of docs.

    ``by`` is an expression over docs that must equal the survivor's mark.
    ``copies`` is the number of rows that carry the same id and mark; where it
    is above 1 (repeated rows) one of them stays. The id is part of the join
    key, so a hot group is spread over the cluster.
    """
    tag = uuid.uuid4().hex
    own_id, own_mark, key, mark, copies = (f"{name}_{tag}" for name in ("own_id", "own_mark", "key", "mark", "copies"))
    chosen = survivors.select(F.col("doc_id").alias(key), (F.col("mark") if by is not None else F.lit(0)).alias(mark), F.col("copies").alias(copies))
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_mark: by if by is not None else F.lit(0)})
    found = marked.join(chosen, F.col(own_id).eqNullSafe(F.col(key)) & (F.col(own_mark) == F.col(mark)))
    once = found.filter(F.col(copies) == 1)
    again = found.filter(F.col(copies) > 1).dropDuplicates([key, mark])
    return once.unionByName(again).drop(own_id, own_mark, key, mark, copies)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    found = cut(exact_dedup(docs, id_col, text_col), "exact-groups")
    survivors = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", F.col("text_sha256").alias("mark")).agg(F.count(F.lit(1)).alias("copies"))
    return keep_rows(docs, survivors, id_col, F.sha2(normal(F.col(text_col)), 256))
