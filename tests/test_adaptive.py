"""Versioned weights: batches count once, states come back, a simulation writes nothing."""

import pytest
from pyspark.sql import functions as F

from loomquery.operators import adaptive
from loomquery.sources.versions import Versions
from loomquery.streaming import events as streaming

FEEDBACK = "intent string, query_id long, factor string, reward double"
STATE = "intent string, factor string, weight double, adjustment double"


def rows(seed, n=12):
    return [("debug" if i % 3 else "test", i // 2 + seed, "ab"[(i * seed) % 2], 0.1 * ((i * seed) % 7) - 0.2) for i in range(n)] + [(None, 1, "a", 9.0), ("debug", None, "a", 9.0)]


def plain(frame):
    return {(r["intent"], r["factor"]): (round(r["weight"], 9), round(r["adjustment"], 9)) for r in frame.collect()}


def after(state, feedback):
    """One update by plain counting."""
    out = dict(state)
    for intent in {i for i, _ in state}:
        own = [r for r in feedback if r[0] == intent and r[1] is not None]
        if len(own) < 5:
            continue
        queries = {r[1] for r in own}
        gradient = {}
        for q in queries:
            signals = [r for r in own if r[1] == q]
            for f in {r[2] for r in signals}:
                gradient[f] = gradient.get(f, 0) + sum(r[2] == f for r in signals) / len(signals) * sum(r[3] for r in signals) / len(queries)
        raw = {f: max(0.01, min(0.5, 0.95 * state[intent, f][0] + 0.05 * gradient.get(f, 0))) for i, f in state if i == intent}
        for f, v in raw.items():
            weight, own_adjustment = v / sum(raw.values()), state[intent, f][1]
            step = max(-0.2, min(0.2, own_adjustment + max(-0.05, min(0.05, weight - own_adjustment))))
            out[intent, f] = weight, own_adjustment * 0.9 + step * 0.1
    return out


@pytest.fixture
def states(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/weights")
    kept.append(spark.createDataFrame([(i, f, 0.5, 0.0) for i in ("debug", "test") for f in "ab"], STATE), "first")
    return kept


def test_batches_count_once(spark, states):
    learn = adaptive.learner(states, F.col("reward"))
    expected = plain(states.read())
    for number, seed in enumerate((1, 2, 5)):
        batch = spark.createDataFrame(rows(seed), FEEDBACK)
        shown = adaptive.simulate(states, batch, F.col("reward"))
        version = states.last()
        shown.collect()
        assert states.last() == version  # nothing written
        for _ in range(2):
            learn(batch, number)
        assert states.last() == version + 1
        expected = after(expected, rows(seed))
        found = plain(states.read())
        assert found.keys() == expected.keys()
        for k, v in found.items():
            assert v == pytest.approx(expected[k], abs=1e-8), k
    learn(spark.createDataFrame([], FEEDBACK), 9)  # an empty batch is a version with the same weights
    assert plain(states.read()) == found


def test_rollback(spark, states):
    learn = adaptive.learner(states, F.col("reward"))
    seen = [plain(states.read())]
    for number, seed in enumerate((1, 2, 5)):
        learn(spark.createDataFrame(rows(seed), FEEDBACK), number)
        seen.append(plain(states.read()))
    assert [plain(states.read(v)) for v in (1, 2, 3, 4)] == seen
    assert states.rollback(2) == 5 and plain(states.read()) == seen[1] and plain(states.read(4)) == seen[3]
    learn(spark.createDataFrame(rows(5), FEEDBACK), 2)  # this batch has had its version
    assert states.last() == 5
    with pytest.raises(ValueError):
        states.rollback(77)


def test_stream_of_feedback(spark, tmp_path, states):
    """Three files, a trigger each, then the query again from the start of its log: the versions stay."""
    for i, seed in enumerate((1, 2, 5)):
        spark.createDataFrame(rows(seed), FEEDBACK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feedback")
    for folder in ("a", "b"):  # the second has lost its own log and delivers all batches anew
        stream = streaming.stream_table(spark, f"{tmp_path}/feedback", 1)
        query = stream.writeStream.foreachBatch(adaptive.learner(states, F.col("reward"))).option("checkpointLocation", f"{tmp_path}/{folder}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert states.last() == 4
    assert states.log().filter("kind = 'batch'").count() == 4


def test_ranking_weights(spark):
    base = spark.createDataFrame([("x", "a", 0.48), ("x", "b", 0.06), ("x", "c", 0.3)], "intent string, factor string, weight double")
    state = spark.createDataFrame([("x", "a", 0.1, 0.1), ("x", "b", 0.1, -0.1)], STATE)
    found = {r["factor"]: r["weight"] for r in adaptive.ranking_weights(base, state).collect()}
    assert found == pytest.approx({"a": 0.5 / 0.85, "b": 0.05 / 0.85, "c": 0.3 / 0.85})
