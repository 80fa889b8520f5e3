"""Change feeds and capture over the events: an event is a change of its user's row, errors delete it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.plans.behaviour import position
from loomquery.plans.registry import query, table
from loomquery.sources.keyed import KeyedTable
from loomquery.sources.stored import shared_dir
from loomquery.streaming import capture
from loomquery.streaming import events as streaming

_STATE = "user_id long, seq long, deleted boolean, event_type string, value double"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")


@query("""
    SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value
    FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'
""")
def fed_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' rows after all changes, which come in four batches out of order, one of them twice."""
    state = KeyedTable(spark, f"{shared_dir(spark)}/users-{uuid.uuid4().hex}", "user_id", _STATE, 16)
    rows = changes(spark, sf_dir)
    for part in (2, 0, 3, 0, 1):
        state.merge(rows.filter(F.pmod("seq", F.lit(4)) == part), f"part-{part}")
    return state.read().select("user_id", "seq", "event_type", F.round("value", 6).alias("value"))


def rules() -> dict[str, Column]:
    return {"kind": F.col("event_type").isin("click", "purchase", "view"), "position": F.col("position").between(1, 7), "value": F.col("value") < 100, "user": F.col("user_id").isNotNull()}


@query("""
    WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 10 + 1 AS position FROM events),
    p AS (SELECT *, list_filter([CASE WHEN NOT coalesce(event_type IN ('click', 'purchase', 'view'), false) THEN 'kind' END, CASE WHEN NOT coalesce(position BETWEEN 1 AND 7, false) THEN 'position' END,
                                 CASE WHEN NOT coalesce(value < 100, false) THEN 'value' END, CASE WHEN user_id IS NULL THEN 'user' END], lambda x: x IS NOT NULL) AS problems FROM e)
    SELECT len(problems) = 0 AS accepted, array_to_string(problems, ',') AS problems, count(*) AS n, round(sum(value), 4) AS total FROM p GROUP BY ALL
""")
def captured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events captured by a stream under four rules: what was kept, and what was turned away and why."""
    folder = f"{shared_dir(spark)}/capture-{uuid.uuid4().hex}"
    events = streaming.stream_table(spark, f"{sf_dir}/events.parquet").withColumn("position", position())
    stream = capture.counted(events, rules())
    stream.writeStream.foreachBatch(capture.keeper(f"{folder}/rows")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    kept = [capture.kept(spark, f"{folder}/rows", False), capture.kept(spark, f"{folder}/rows", True).withColumn("problems", F.array().cast("array<string>"))]
    both = kept[0].select("problems", "value").unionByName(kept[1].select("problems", "value"))
    return both.groupBy((F.size("problems") == 0).alias("accepted"), F.concat_ws(",", "problems").alias("problems")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
