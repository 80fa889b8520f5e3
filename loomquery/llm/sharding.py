"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions

#: What a row weighs besides its text, in bytes.
ROW_OVERHEAD = 16


def interleave_shards(
    df: DataFrame, shards: int = 40, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", buckets: int | None = None
) -> DataFrame:
    """Deal rows into shards whose counts differ by at most one and whose mixture of strata matches the whole.

    Rows of a stratum are shuffled by a seeded digest and ranked 1..n; the row
    of rank r stands at the fraction (r - 1/2) / n. All rows sorted by fraction
    are cut into ``shards`` equal stretches, so each shard takes its share of
    every stratum to within one row.

    No rank is made in one task: the shuffle digest and the fraction are both
    uniform, so each is cut into buckets of near equal size whatever the
    stratum's share; counts per bucket, summed in order, give the rank at which
    each bucket begins, and only rows of one bucket are ever sorted together.
    The number of buckets steers the task size and cannot change the result.

    Returns doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard
    (null: this law deals all rows anew when shards are added).

    Null text weighs nothing and has crc32 0. A null stratum is a stratum of
    its own. Repeated rows and null ids are dealt like others: ties fall to the
    other output columns, and rows alike in all of them are interchangeable.
    An empty table gives an empty result; other columns are ignored.
    """
    buckets = buckets or max(256, 4 * partitions(df.sparkSession))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"),
    ).select("*", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))).alias("draw"))
    base = cut(base.withColumn("part", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")), "shard-rows")
    order = ["draw", "doc_id", "text_crc32", "size"]

    counts = base.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("stratum").orderBy("part")
    starts = counts.select(
        "stratum",
        "part",
        (F.sum("n").over(by_part) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("stratum")).alias("total"),
    )
    within = F.row_number().over(Window.partitionBy("stratum", "part").orderBy(*order))
    ranked = base.withColumn("nth", within).join(starts, ["stratum", "part"])
    fraction = (2 * (F.col("before") + F.col("nth")) - 1) / (2 * F.col("total"))
    placed = cut(
        ranked.select("doc_id", "size", "text_crc32", "stratum", "draw", fraction.alias("fraction")).withColumn("part", F.floor(F.col("fraction") * buckets).cast("int")),
        "shard-fractions",
    )

    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket: the number of buckets bounds this window, not the input.
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("fraction", "stratum", *order))
    at = F.col("before") + F.col("nth") - 1
    # Whole numbers all the way: at 10^15 rows a double would no longer tell neighbours apart.
    shard = F.expr(f"((before + nth) * {shards}L - 1) div total").cast("int")
    return (
        placed.withColumn("nth", within)
        .join(starts, "part")
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), at.alias("at"), "total", shard.alias("shard"))
        .select("doc_id", "size", "text_crc32", "law", "shard", F.expr(f"at - (shard * total) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
