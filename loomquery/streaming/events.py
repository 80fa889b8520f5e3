"""Structured Streaming forms of the stateful behaviours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, with the schema it has on disk."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.parquet(f"{path}*")  # a folder of files and a single file alike
    # Event time needs an instant; a time without zone counts as UTC.
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window_start, key, n, total per tumbling window; rows later than the watermark are dropped."""
    of = events.withWatermark(ts, late).groupBy(F.window(ts, length), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return of.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sliding_counts(events: DataFrame, ts: str, key: str, length: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    of = events.withWatermark(ts, late).groupBy(F.window(ts, length, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return of.select(F.col("window.end").alias("window_end"), key, "n")


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, session_start, session_end, n; a pause of up to the gap stays in the session."""
    of = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return of.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def paired(shown: DataFrame, selected: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Interactions joined with their selections, by key, while both are within the time given."""
    a, b = shown.withWatermark(ts, within).alias("a"), selected.withWatermark(ts, within).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{ts}") >= F.col(f"a.{ts}")) & (F.col(f"b.{ts}") <= F.col(f"a.{ts}") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select(F.col(f"a.{key}").alias(key), F.col(f"a.{ts}").alias("shown_at"), F.col(f"b.{ts}").alias("selected_at"))


def without_repeats(chunks: DataFrame, ts: str, keys: list[str], within: str = "10 minutes") -> DataFrame:
    return chunks.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def rate_limited(requests: DataFrame, user: str, ts: str, number: str, most: int = 100, seconds: int = 60, burst: int = 10, late: str = "1 hour") -> DataFrame:
    """user, ts, number, accepted: a sliding limit in which only accepted requests count.

    Requests are decided in the order of (ts, number), whatever order, batches
    or triggers they come in: each waits in its user's state until the watermark,
    ``late`` behind the latest request, has passed it. So the state holds the
    requests of that time, and the accepted times within the window, ``most`` at
    most. Requests that come after the watermark has passed them are dropped (and
    counted, see dropped()). Those the watermark never passes stay open: drain()
    can close a stream that has ended. Rows with a null time or user take no
    part; repeated rows are requests of their own.
    """
    gap, second = seconds * 1_000_000, 1_000_000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, numbers, accepted = (list(x) for x in state.get) if state.exists else ([], [], [])
        for batch in batches:
            times += batch[ts].astype("datetime64[us]").astype("int64").tolist()
            numbers += batch[number].tolist()
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(zip(times, numbers))
        due = [w for w in waiting if w[0] < passed]
        answers = []
        for at, _ in due:
            accepted = [t for t in accepted if t > at - gap]
            fits = len(accepted) < most and sum(t > at - second for t in accepted) < burst
            answers.append(fits)
            if fits:
                accepted.append(at)
        waiting = waiting[len(due) :]
        if waiting or accepted:
            state.update(([t for t, _ in waiting], [n for _, n in waiting], accepted))
            # Called again when the first one waiting is due, or the last one accepted no longer counts.
            state.setTimeoutTimestamp(max(passed // 1000 + 1, (waiting[0][0] if waiting else accepted[-1] + gap) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({user: [key[0]] * len(due), ts: pd.Series([at for at, _ in due], dtype="datetime64[us]"), number: pd.Series([n for _, n in due], dtype="int64"), "accepted": pd.Series(answers, dtype=bool)})

    kind = dict(requests.dtypes)[user]
    known = requests.select(user, ts, F.col(number).cast("long").alias(number)).filter(F.col(ts).isNotNull() & F.col(user).isNotNull()).withWatermark(ts, late)
    return known.groupBy(user).applyInPandasWithState(decide, f"{user} {kind}, {ts} timestamp, {number} long, accepted boolean", "times array<long>, numbers array<long>, accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def with_end(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` and what later appears in ``folder`` as Parquet files of the same columns: drain() puts a stream's end there."""
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("ignore").parquet(folder)
    return rows.unionByName(rows.sparkSession.readStream.schema(rows.schema).parquet(folder))


def dropped(query: StreamingQuery) -> int:
    """Rows that a query's operators left out because they came too late."""
    return sum(int(op.numRowsDroppedByWatermark) for progress in query.recentProgress for op in progress.stateOperators)


def drain(stream: DataFrame, folder: str, mode: str = "append", end: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    With ``end``, a frame of rows and the folder that with_end() watches, these
    rows follow when all else has been read: rows of a later time let the
    watermark pass all there was.
    """
    spark = stream.sparkSession

    def run() -> StreamingQuery:
        if mode == "append":
            writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        else:

            def put(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{folder}/out")

            writer = stream.writeStream.outputMode(mode).foreachBatch(put)
        query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    run()
    if end is not None:
        end[0].write.mode("append").parquet(end[1])
        run()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
