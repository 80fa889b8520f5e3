"""Behaviour analytics: sessions, click-through, rewards, trends and learned weights. Time comes in as a parameter, never from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.sources.stored import stored

# Words too common to trend.
TREND_STOP_WORDS = ["this", "that", "with", "from", "have", "will", "what", "when", "where"]


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Adds session (from 1 per user): a pause of more than the gap, to the microsecond, begins a new one."""
    by = Window.partitionBy(user).orderBy(ts, *[c for c in events.columns if c.endswith("_id") and c != user])
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(by).cast("timestamp"))
    return events.withColumn("_new", F.when(pause.isNull() | (pause > 60_000_000 * gap_minutes), 1).otherwise(0)).withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def refinements(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Adds added and removed (words against the turn before) and kind."""
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != ""))
    before = F.lag("_words").over(Window.partitionBy(conversation).orderBy(turn))
    out = turns.withColumn("_words", own).withColumn("_before", before)
    added, removed = F.array_except("_words", "_before"), F.array_except("_before", "_words")
    kind = (
        F.when(F.col("_before").isNull(), "first")
        .when((F.size(added) > 0) & (F.size(removed) == 0), "expansion")
        .when((F.size(added) == 0) & (F.size(removed) > 0), "narrowing")
        .when((F.size(added) == 0) & (F.size(removed) == 0), "repeat")
        .otherwise("reformulation")
    )
    return out.withColumn("added", F.coalesce(F.size(added), F.lit(0)).cast("long")).withColumn("removed", F.coalesce(F.size(removed), F.lit(0)).cast("long")).withColumn("kind", kind).drop("_words", "_before")


def click_through(shown: DataFrame, position: Column, clicked: Column, most: int = 10) -> DataFrame:
    """position, shows, clicks, ctr."""
    at = shown.select(position.cast("long").alias("position"), clicked.cast("int").alias("clicked")).filter((F.col("position") >= 0) & (F.col("position") < most))
    return at.groupBy("position").agg(F.count(F.lit(1)).alias("shows"), F.sum("clicked").alias("clicks")).withColumn("ctr", F.col("clicks") / F.col("shows"))


def reward(signal: Column, position: Column) -> Column:
    """Of one signal: a click by place, a copy, a refinement, or nothing."""
    click = F.when(position <= 3, 0.3).when(position <= 5, 0.1).otherwise(0.05)
    return F.when(signal == "click", click).when(signal == "copy", 0.5).when(signal == "refinement", -0.025).otherwise(-0.05)


def signal_metrics(signals: DataFrame, query: str, signal: Column, position: Column) -> DataFrame:
    """One row of rates per query: click-through, refinement, copy, success in the first three, mean click position."""
    of = signals.select(F.col(query).alias("q"), signal.alias("s"), position.alias("p"))
    per = of.groupBy("q").agg(
        F.max((F.col("s") == "click").cast("int")).alias("clicked"),
        F.max((F.col("s") == "refinement").cast("int")).alias("refined"),
        F.max((F.col("s") == "copy").cast("int")).alias("copied"),
        F.max(((F.col("s") == "click") & (F.col("p") <= 3)).cast("int")).alias("early"),
        F.sum(F.when(F.col("s") == "click", F.col("p"))).alias("places"),
        F.count_if(F.col("s") == "click").alias("clicks"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg("clicked").alias("ctr"),
        F.avg("refined").alias("refinement_rate"),
        F.avg("copied").alias("copy_rate"),
        F.avg("early").alias("success_at_3"),
        (F.sum("places") / F.sum("clicks")).alias("mean_click_position"),
    )


def updated_weights(shares: DataFrame, group: str, factor: str, weight: Column, gradient: Column, rate: float = 0.05, decay: float = 0.95, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """New weights: decay * weight + rate * gradient, held in bounds, adding up to 1 per group."""
    raw = F.greatest(F.lit(low), F.least(F.lit(high), decay * weight + rate * gradient))
    return shares.withColumn("weight", raw / F.sum(raw).over(Window.partitionBy(group)))


def trending(texts: DataFrame, text: str, limit: int = 20, least_length: int = 4) -> DataFrame:
    """topic, n: the words most used, short and common ones left out."""
    topic = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")).alias("topic"))
    return topic.filter((F.length("topic") >= least_length) & ~F.col("topic").isin(TREND_STOP_WORDS)).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(limit)


def top_values(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """group, value, n, rank: the k most frequent values of each group."""
    n = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return n.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def dominant_shares(rows: DataFrame, value: str, least: float) -> DataFrame:
    """value, n, share of those that make up more than ``least`` of all rows."""
    n = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return n.withColumn("share", F.col("n") / F.lit(max(1, total))).filter(F.col("share") > least)


def path_prefixes(paths: DataFrame, path: str, depth: int = 3, limit: int = 5) -> DataFrame:
    """prefix, n: the directories of depth 1 to ``depth`` most used."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    most = F.least(F.lit(depth), F.size(parts) - 1)
    each = F.when(most >= 1, F.transform(F.sequence(F.lit(1), most), lambda i: F.concat_ws("/", F.slice(parts, 1, i))))
    return paths.select(F.explode(each).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(limit)


def running_mean(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Adds mean_so_far, the mean of a group's values up to each row.

    Rows are ordered over all partitions first; each partition adds up its own
    part of a group, and starts from the sum of the parts before it. So a group
    that holds most rows is spread over the cluster.
    """
    placed = stored(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "running-mean")
    parts = placed.groupBy(F.col(group).alias("_group"), "_part").agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_group", F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    seen = F.col("_n") + F.count(value).over(inside)
    return joined.withColumn("mean_so_far", (F.col("_sum") + F.coalesce(F.sum(value).over(inside), F.lit(0))) / F.nullif(seen, F.lit(0))).select(*rows.columns, "mean_so_far")
