"""The sliding limit over a stream: event time decides, not the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from loomquery.streaming import events as streaming

SCHEMA = "user long, ts timestamp, id long"


def brute(rows, most, seconds, burst):
    accepted, out = {}, []
    for ts, number, user in sorted((ts, number, user) for user, ts, number in rows):
        own = accepted.setdefault(user, [])
        fits = sum(t > ts - seconds for t in own) < most and sum(t > ts - 1 for t in own) < burst
        if fits:
            own.append(ts)
        out.append((user, number, fits))
    return sorted(out)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("files", [1, 3])
def test_any_order(spark, tmp_path, small_batches, files):
    rng = random.Random(files)
    rows = [(rng.choice([1, 1, 1, 2, 3]), round(rng.uniform(0, 60) * 4) / 4, i) for i in range(120)]
    rng.shuffle(rows)
    spark.range(1).select(F.lit(0)).count()
    for i in range(files):
        part = spark.createDataFrame([(u, float(t), n) for u, t, n in rows[i::files]], "user long, t double, id long").select("user", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "id")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
    stream = streaming.stream_table(spark, f"{tmp_path}/requests", 1)
    limited = streaming.rate_limited(streaming.with_end(stream, f"{tmp_path}/end"), "user", "ts", "id", most=5, seconds=20, burst=2, late="2 minutes")
    last = spark.createDataFrame([(None, 10_000.0, -1)], "user long, t double, id long").select(F.lit(-1).cast("long").alias("user"), F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "id")
    found = streaming.drain(limited, f"{tmp_path}/run", end=(last, f"{tmp_path}/end"))
    assert sorted((r["user"], r["id"], r["accepted"]) for r in found.collect()) == brute(rows, 5, 20, 2)


def test_late_requests_are_counted(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "user long, t double, id long").select("user", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("ts"), "id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")

    stream_folder = f"{tmp_path}/requests"
    put([(1, 1000.0, 1), (1, 5000.0, 2), (None, 1.0, 8)])
    stream = streaming.stream_table(spark, stream_folder)
    limited = streaming.rate_limited(stream, "user", "ts", "id", most=5, seconds=20, burst=2, late="1 minute")

    def run():
        query = limited.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    assert streaming.dropped(run()) == 0
    put([(1, 1500.0, 3), (2, 6000.0, 4)])  # the first is 58 minutes behind the watermark
    assert streaming.dropped(run()) == 1
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["id"], r["accepted"]) for r in found.collect()) == [(1, True), (2, True)]  # the last one is still open
