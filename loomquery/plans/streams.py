"""Streaming forms over the events, drained once over all that is there; results equal those in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans.registry import query, table
from loomquery.sources.stored import shared_dir
from loomquery.streaming import events as streaming


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.stream_table(spark, f"{sf_dir}/events.parquet")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streaming.windowed_counts(_events(spark, sf_dir), "ts", "event_type", "value", "1 day", "31 days")
    return streaming.drain(counts, _folder(spark), "complete").withColumn("total", F.round("total", 4))


@query("""
    WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = streaming.session_counts(_events(spark, sf_dir), "ts", "user_id", "30 minutes", "31 days")
    return streaming.drain(sessions, _folder(spark), "complete").select("user_id", "session_start", "n")


@query("SELECT count(DISTINCT event_id) AS n FROM events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = streaming.without_repeats(_events(spark, sf_dir).select("event_id", "ts"), "ts", ["event_id"], "31 days")
    return streaming.drain(kept, _folder(spark)).agg(F.count(F.lit(1)).alias("n"))


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests in half an hour; only accepted ones count, so each decision depends on those before it."""
    folder = _folder(spark)
    events = _events(spark, sf_dir).select("user_id", "ts", "event_id")
    decided = streaming.rate_limited(streaming.with_end(events, f"{folder}/end"), "user_id", "ts", "event_id", most=2, seconds=1800, burst=2)
    # A request of nobody's in particular, a day after all others; no time passes it, so it stays open itself.
    last = table(spark, sf_dir, "events").agg((F.max("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(-1).cast("long").alias("event_id"))
    return streaming.drain(decided, folder, end=(last, f"{folder}/end"))
