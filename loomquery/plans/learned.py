"""Weights learned batch by batch from the events: users stand for queries, kinds of event for factors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import adaptive, feedback
from loomquery.operators.ranking import WEIGHTS
from loomquery.plans.behaviour import _POSITION, _SIGNAL, position, signal
from loomquery.plans.registry import query, rounded, table
from loomquery.sources.stored import shared_dir
from loomquery.sources.versions import Versions

INTENTS = list(WEIGHTS)
KINDS = ["click", "error", "purchase", "signup", "view"]
#: Days of the month that make a batch.
BATCHES = [(1, 10), (11, 20), (21, 31)]


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """intent, query_id, factor, day and what the reward asks for."""
    names = F.array(*[F.lit(i) for i in INTENTS])
    return table(spark, sf_dir, "events").select(F.get(names, (F.col("user_id") % len(INTENTS)).cast("int")).alias("intent"), F.col("user_id").alias("query_id"), F.col("event_type").alias("factor"), F.dayofmonth("ts").alias("day"), feedback.reward(signal(), position()).alias("reward"))


def first_state(spark: SparkSession) -> DataFrame:
    """All factors weigh the same and nothing is adjusted."""
    each = F.explode(F.array(*[F.lit(i) for i in INTENTS])).alias("intent")
    return spark.range(1).select(each).select("intent", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("factor"), F.lit(0.2).alias("weight"), F.lit(0.0).alias("adjustment"))


def states(spark: SparkSession) -> Versions:
    kept = Versions(spark, f"{shared_dir(spark)}/weights-{uuid.uuid4().hex}")
    kept.append(first_state(spark), "first")
    return kept


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _steps(batches: list[tuple[int, int]]) -> str:
    """CTEs s0, s1, ...: the state (intent, factor, weight, adjustment) after each batch, and p1, ... with its proposal."""
    out = f"""
        f AS (SELECT {_list(INTENTS)}[user_id % {len(INTENTS)} + 1] AS intent, user_id AS query_id, event_type AS factor, day(ts) AS day,
                     CAST(CASE s WHEN 'click' THEN CASE WHEN p <= 3 THEN 0.3 WHEN p <= 5 THEN 0.1 ELSE 0.05 END WHEN 'copy' THEN 0.5 WHEN 'refinement' THEN -0.025 ELSE -0.05 END AS DOUBLE) AS reward
              FROM (SELECT *, {_SIGNAL} AS s, {_POSITION} AS p FROM events)),
        s0 AS (SELECT i.intent, k.factor, 0.2::DOUBLE AS weight, 0::DOUBLE AS adjustment FROM (SELECT unnest({_list(INTENTS)}) AS intent) i, (SELECT unnest({_list(KINDS)}) AS factor) k)"""
    for n, (low, high) in enumerate(batches, 1):
        out += f""",
        q{n} AS (SELECT intent, query_id, factor, sum(sum(reward)) OVER w AS reward, count(*) / sum(count(*)) OVER w AS share, count(*) AS n
                 FROM f WHERE day BETWEEN {low} AND {high} GROUP BY intent, query_id, factor WINDOW w AS (PARTITION BY intent, query_id)),
        i{n} AS (SELECT intent, count(DISTINCT query_id) AS queries, sum(n) AS items FROM q{n} GROUP BY intent),
        g{n} AS (SELECT intent, factor, sum(share * reward) / any_value(queries) AS gradient FROM q{n} JOIN i{n} USING (intent) GROUP BY intent, factor),
        r{n} AS (SELECT s.*, items, greatest(0.01, least(0.5, 0.95 * s.weight + 0.05 * coalesce(gradient, 0))) AS raw
                 FROM s{n - 1} s LEFT JOIN g{n} USING (intent, factor) LEFT JOIN i{n} USING (intent)),
        p{n} AS (SELECT intent, factor, weight, adjustment, CASE WHEN items >= 5 THEN raw / sum(raw) OVER (PARTITION BY intent) END AS proposal FROM r{n}),
        s{n} AS (SELECT intent, factor, coalesce(proposal, weight) AS weight,
                        CASE WHEN proposal IS NULL THEN adjustment ELSE 0.9 * adjustment
                            + 0.1 * greatest(-0.2, least(0.2, adjustment + greatest(-0.05, least(0.05, proposal - adjustment)))) END AS adjustment FROM p{n})"""
    return out


_LAST = len(BATCHES)


@query(f"""
    WITH {_steps(BATCHES)},
    m AS (SELECT intent, factor, weight, adjustment, greatest(0.05, least(0.5, 0.2 + adjustment)) AS raw FROM s{_LAST})
    SELECT intent, factor, round(weight, 6) AS weight, round(adjustment, 6) AS adjustment, round(raw / sum(raw) OVER (PARTITION BY intent), 6) AS ranking_weight FROM m
""")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events, the second delivered twice: a batch counts once."""
    kept, rows = states(spark), told(spark, sf_dir)
    learn = adaptive.learner(kept, F.col("reward"))
    for n, (low, high) in [(0, BATCHES[0]), (1, BATCHES[1]), (1, BATCHES[1]), (2, BATCHES[2])]:
        learn(rows.filter(F.col("day").between(low, high)), n)
    base = first_state(spark).select("intent", "factor", "weight")
    ranked = adaptive.ranking_weights(base, kept.read()).withColumnRenamed("weight", "ranking_weight")
    return rounded(kept.read().join(ranked, ["intent", "factor"]), "weight", "adjustment", "ranking_weight")


@query(f"WITH {_steps(BATCHES[:2])} SELECT 'before' AS state, intent, factor, round(weight, 6) AS weight, round(adjustment, 6) AS adjustment FROM s2 UNION ALL SELECT 'after', intent, factor, round(weight, 6), round(adjustment, 6) FROM s1")
def weights_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights after two batches, and after going back by one: what the first batch left."""
    kept, rows = states(spark), told(spark, sf_dir)
    learn = adaptive.learner(kept, F.col("reward"))
    for n, (low, high) in enumerate(BATCHES[:2]):
        learn(rows.filter(F.col("day").between(low, high)), n)
    before = kept.read()
    kept.rollback(kept.last() - 1)
    both = before.withColumn("state", F.lit("before")).unionByName(kept.read().withColumn("state", F.lit("after")))
    return rounded(both, "weight", "adjustment").select("state", "intent", "factor", "weight", "adjustment")


@query(f"WITH {_steps(BATCHES[:1])} SELECT intent, factor, round(weight, 6) AS weight, round(proposal, 6) AS proposal FROM p1")
def weight_update_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first batch would change; no version is written."""
    kept = states(spark)
    found = adaptive.simulate(kept, told(spark, sf_dir).filter(F.col("day").between(*BATCHES[0])), F.col("reward"))
    return rounded(found, "weight", "proposal").select("intent", "factor", "weight", "proposal")
