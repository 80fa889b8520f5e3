"""Change feeds: batches once, any order of arrival. Capture: one pass for accepted and rejected rows."""

import itertools

from pyspark.sql import functions as F

from loomquery.sources.keyed import KeyedTable
from loomquery.streaming import capture
from loomquery.streaming import events as streaming

STATE = "id long, seq long, deleted boolean, name string"
CHANGES = [(1, 1, False, "a"), (2, 2, False, "b"), (1, 3, False, "c"), (2, 4, True, None), (3, 5, None, "d"), (1, 2, False, "late"), (None, 9, False, "x"), (4, None, False, "x"), (5, 6, True, "gone"), (5, 5, False, "back"), (3, 5, None, "d")]
WANT = [(1, 3, "c"), (3, 5, "d")]


def rows(table, version=None):
    return sorted((r["id"], r["seq"], r["name"]) for r in table.read(version).collect())


def test_any_order_of_batches(spark, tmp_path):
    parts = [CHANGES[:4], CHANGES[4:8], CHANGES[8:]]
    for n, order in enumerate(itertools.islice(itertools.permutations(range(3)), 0, 6, 2)):
        table = KeyedTable(spark, f"file://{tmp_path}/{n}", "id", STATE, 4)
        assert rows(table) == []
        for i in [*order, order[0]]:
            new = table.merge(spark.createDataFrame(parts[i], STATE), f"b{i}")
        assert not new and rows(table) == WANT
        assert table.log().count() == 3


def test_only_touched_parts_are_written(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id", STATE, 8)
    table.merge(spark.createDataFrame([(i, 1, False, "x") for i in range(100)], STATE), "all")
    table.merge(spark.createDataFrame([(7, 2, False, "y")], STATE), "one")
    table.merge(spark.createDataFrame([], STATE), "none")
    assert [len(r["buckets"]) for r in table.log().orderBy("version").collect()] == [8, 1, 0]
    assert (7, 2, "y") in rows(table) and len(rows(table)) == 100 and (7, 1, "x") in rows(table, 1)


def test_feed_as_a_stream(spark, tmp_path):
    for part in (CHANGES[6:], CHANGES[:3], CHANGES[3:6]):
        spark.createDataFrame(part, STATE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
    table = KeyedTable(spark, f"file://{tmp_path}/t", "id", STATE, 4)
    for log in ("a", "b"):  # the second run has lost its log and delivers everything again
        stream = streaming.stream_table(spark, f"{tmp_path}/changes", 1)
        stream.writeStream.foreachBatch(table.merger()).option("checkpointLocation", f"{tmp_path}/{log}").trigger(availableNow=True).start().awaitTermination()
        assert rows(table) == WANT and table.log().count() == 3


def test_capture(spark, tmp_path):
    data = [(1, "click", 3), (2, "other", 3), (3, "click", 99), (4, None, None), (5, "click", 1)]
    for part in (data[:3], data[3:]):
        spark.createDataFrame(part, "id long, kind string, place long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rules = {"kind": F.col("kind") == "click", "place": F.col("place") < 10}
    for log in ("a", "b"):
        stream = capture.counted(streaming.stream_table(spark, f"{tmp_path}/in", 1), rules)
        query = stream.writeStream.foreachBatch(capture.keeper(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/{log}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r["id"] for r in capture.kept(spark, f"{tmp_path}/out", True).collect()) == [1, 5]
        assert sorted((r["id"], tuple(r["problems"])) for r in capture.kept(spark, f"{tmp_path}/out", False).collect()) == [(2, ("kind",)), (3, ("place",)), (4, ("kind", "place"))]
        assert capture.observed(query) == {"rows": 5, "accepted": 2, "kind": 2, "place": 2}
