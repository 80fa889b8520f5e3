"""Statistics of feedback, sessions, style and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import naming_style
from loomquery.sources.stored import stored


def outcome_statistics(records: DataFrame, success: Column, rating: Column) -> DataFrame:
    """One row: total, success_rate, mean_rating (0 if nothing is rated), rated."""
    total = F.count(F.lit(1))
    return records.agg(total.alias("total"), F.coalesce(F.count_if(success) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("success_rate"), F.coalesce(F.avg(rating), F.lit(0.0)).alias("mean_rating"), F.count(rating).alias("rated"))


def exact_median(rows: DataFrame, value: Column) -> DataFrame:
    """median of the values that are there, in one row (null if there are none).

    Equal values are counted first. Ranges of values then hold their counts'
    running sums, each starting from the sum of the ranges before it; so no task
    has all values, and only the two in the middle are left.
    """
    counts = rows.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "median-counts")
    parts = placed.groupBy("part").agg(F.sum("n").alias("own"))  # a row for each range
    starts = parts.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("start"), F.sum("own").over(Window.partitionBy()).alias("total"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    inside = placed.join(F.broadcast(starts), "part").withColumn("upto", upto)
    middle = [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)]
    held = [(F.col("upto") > m) & (F.col("upto") - F.col("n") <= m) for m in middle]
    return inside.filter(held[0] | held[1]).agg(F.avg("v").alias("median"))


def response_times(records: DataFrame, ms: Column) -> DataFrame:
    """mean and median of the times that are there and not 0."""
    known = F.when(ms != 0, ms)
    mean = records.agg(F.coalesce(F.avg(known), F.lit(0.0)).alias("mean"))
    # Two single rows.
    return mean.join(F.broadcast(exact_median(records, known)), F.lit(True), "left").select("mean", F.coalesce("median", F.lit(0.0)).alias("median"))


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, share: each key's part of the sum of all values. One row a key is left before the window."""
    return rows.groupBy(key).agg(F.sum(value).alias("_v")).select(key, (F.col("_v") / F.nullif(F.sum("_v").over(Window.partitionBy()), F.lit(0.0))).alias("share"))


def session_totals(sessions: DataFrame, start: str, end: str, n: str, now: Column, timeout_minutes: int = 30) -> DataFrame:
    """One row over sessions: how many there are, how many are active, their interactions and mean minutes."""
    began, ended = (F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end))
    active = F.unix_micros(now) - ended < 60_000_000 * timeout_minutes
    minutes = F.sum(ended - began) / F.count(began + ended) / 60_000_000  # whole microseconds are added, so no order of rows changes the sum
    return sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(active).alias("active"), F.coalesce(F.sum(n), F.lit(0)).alias("interactions"), F.coalesce(minutes, F.lit(0.0)).alias("mean_minutes"))


def newest(rows: DataFrame, by: str | None, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group, or of all; place counts from the newest."""
    if by is None:
        return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])).cast("long")).filter(F.col("place") <= n)


def newest_distinct(rows: DataFrame, by: str, item: str, order: list[str], n: int) -> DataFrame:
    """by, item, place: the ``n`` items of each group met last, each once."""
    last = rows.groupBy(by, item).agg(F.max(F.struct(*order)).alias("_last"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_last"))).cast("long")).filter(F.col("place") <= n).drop("_last")


def operation_metrics(rows: DataFrame, operation: str, value: str, order: list[str], last: int = 1000) -> DataFrame:
    """operation, n, mean, least, most, latest over the last operations of each kind."""
    kept = newest(rows, operation, order, last)
    return kept.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.max_by(value, F.struct(*order)).alias("latest"))


def style_vote(words: DataFrame, group: str, word: str) -> DataFrame:
    """group, style, n, consistency: the commonest naming style, and 1 minus the entropy of styles over its highest possible value."""
    n = words.groupBy(group, naming_style(F.col(word)).alias("style")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    p = F.col("n") / F.col("total")
    best = n.join(total, group).groupBy(group).agg(
        F.max_by(F.struct("style", "n"), F.struct("n", "style")).alias("b"),
        F.when(F.max("kinds") > 1, 1 + F.sum(p * F.log(p)) / F.log(F.max("kinds"))).otherwise(1.0).alias("consistency"),
    )
    return best.select(group, "b.style", "b.n", "consistency")


def line_length(texts: DataFrame, group: str, text: str, most: int = 120) -> DataFrame:
    """group, line_length: the smallest length that nine tenths of the lines stay below, at most ``most``. Lengths are counted before they meet."""
    lengths = texts.select(group, F.explode(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), F.length)).alias("length")).groupBy(group, "length").agg(F.count(F.lit(1)).alias("n"))
    below = F.sum("n").over(Window.partitionBy(group).orderBy("length"))
    total = F.sum("n").over(Window.partitionBy(group))
    return lengths.withColumn("below", below).withColumn("total", total).filter("below > floor(total * 0.9)").groupBy(group).agg(F.least(F.lit(most), F.min("length")).cast("long").alias("line_length"))


def common_members(files: DataFrame, group: str, members: str, least: float = 0.3) -> DataFrame:
    """group, member, support: what at least that share of a group's files have. ``members`` is an array without repeats."""
    size = files.groupBy(group).agg(F.count(F.lit(1)).alias("files"))
    n = files.select(group, F.explode(members).alias("member")).groupBy(group, "member").agg(F.count(F.lit(1)).alias("n"))
    return n.join(size, group).select(group, "member", (F.col("n") / F.col("files")).alias("support")).filter(F.col("support") >= least)


def enrichment(items: DataFrame, vectors: DataFrame, key: str, text: str) -> DataFrame:
    """One row: items processed, those that have a vector, those that can't have one, and those still to do."""
    have = items.join(vectors.select(F.col(key), F.lit(True).alias("_there")).distinct(), key, "left")
    blank = F.length(F.trim(F.coalesce(text, F.lit("")))) == 0
    return have.agg(F.count(F.lit(1)).alias("processed"), F.count_if("_there").alias("enriched"), F.count_if(F.col("_there").isNull() & blank).alias("failed"), F.count_if(F.col("_there").isNull() & ~blank).alias("open"))


def clean_minmax(value: Column, *by: str) -> Column:
    """Scores of a list between 0 and 1: what is no finite number counts as 0 first, and no spread is neutral."""
    w = Window.partitionBy(*by)
    clean = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)
    low, high = F.min(clean).over(w), F.max(clean).over(w)
    return F.when(high > low, (clean - low) / (high - low)).otherwise(0.5)


def learned_by_intent(signals: DataFrame, intent: str, value: str, least: int = 5, rate: float = 0.1, step: float = 0.05) -> DataFrame:
    """intent, n, adjustment: for intents with enough signals the mean above or below a half, damped by the rate and held to the step."""
    found = signals.groupBy(intent).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean")).filter(F.col("n") >= least)
    return found.select(intent, "n", F.greatest(F.lit(-step), F.least(F.lit(step), (F.col("_mean") - 0.5) * rate)).alias("adjustment"))
