"""Ranking weights that follow feedback: simulated, applied batch by batch, brought back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.operators.feedback import updated_weights
from loomquery.sources.versions import Versions

# Fixed values of the learning rule.
LEARNING_RATE = 0.1
MOST_CHANGE, MOST_ADJUSTMENT = 0.05, 0.2
LEAST_WEIGHT, MOST_WEIGHT = 0.05, 0.5
LEAST_ITEMS = 5


def gradients(feedback: DataFrame, reward: Column, value: Column | float = 1.0) -> DataFrame:
    """intent, factor, gradient, items: how the queries' rewards speak for each factor.

    ``feedback``: intent, query_id, factor, one row for each signal. A query's
    reward is the sum of ``reward`` over its signals; each factor gets the part
    of it that its share of the query's ``value`` is, as a mean over the
    intent's queries. items is the number of the intent's signals. Rows without
    intent or query take no part; a query whose values add up to nothing speaks
    for no factor.
    """
    rows = feedback.filter("intent is not null and query_id is not null")
    per = rows.groupBy("intent", "query_id", "factor").agg(F.sum(reward).alias("r"), F.sum(value if isinstance(value, Column) else F.lit(value)).alias("v"), F.count(F.lit(1)).alias("n"))
    # Factors are few, so this is a row for each query and factor at most.
    whole = Window.partitionBy("intent", "query_id")
    shares = per.withColumns({"reward": F.sum("r").over(whole), "share": F.coalesce(F.try_divide("v", F.sum("v").over(whole)), F.lit(0.0))})
    intents = per.groupBy("intent").agg(F.count_distinct("query_id").alias("queries"), F.sum("n").alias("items"))
    by_factor = shares.filter("factor is not null").groupBy("intent", "factor").agg(F.sum(F.col("share") * F.col("reward")).alias("moved"))
    return by_factor.join(F.broadcast(intents), "intent").select("intent", "factor", (F.col("moved") / F.col("queries")).alias("gradient"), "items")


def proposed(state: DataFrame, found: DataFrame) -> DataFrame:
    """``state`` (intent, factor, weight, adjustment) with proposal: the weight that the gradients ask for, null where an intent has less than LEAST_ITEMS signals. Nothing is written."""
    asked = state.join(found, ["intent", "factor"], "left")
    items = F.max("items").over(Window.partitionBy("intent"))
    new = updated_weights(asked.withColumn("old", F.col("weight")), "intent", "factor", F.col("old"), F.coalesce("gradient", F.lit(0.0)))
    return new.withColumn("items", F.coalesce(items, F.lit(0))).select("intent", "factor", F.col("old").alias("weight"), "adjustment", F.when(F.col("items") >= LEAST_ITEMS, F.col("weight")).alias("proposal"))


def bounded(value: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value))


def adapted(simulated: DataFrame) -> DataFrame:
    """The state after proposed(): weights are the proposals, adjustments move towards them, by limited steps within limits and by the learning rate."""
    own = F.col("adjustment")
    step = bounded(own + bounded(F.col("proposal") - own, MOST_CHANGE), MOST_ADJUSTMENT)
    moved = own * (1 - LEARNING_RATE) + step * LEARNING_RATE
    return simulated.select("intent", "factor", F.coalesce("proposal", "weight").alias("weight"), F.when(F.col("proposal").isNotNull(), moved).otherwise(own).alias("adjustment"))


def ranking_weights(base: DataFrame, state: DataFrame) -> DataFrame:
    """intent, factor, weight: ``base`` weights moved by the adjustments, within limits and adding up to 1 for each intent."""
    moved = base.join(state.select("intent", "factor", "adjustment"), ["intent", "factor"], "left")
    raw = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.col("weight") + F.coalesce("adjustment", F.lit(0.0))))
    return moved.withColumn("raw", raw).select("intent", "factor", (F.col("raw") / F.sum("raw").over(Window.partitionBy("intent"))).alias("weight"))


def simulate(states: Versions, feedback: DataFrame, reward: Column) -> DataFrame:
    """intent, factor, weight, adjustment, proposal as of the last version; nothing is written."""
    return proposed(states.read(), gradients(feedback, reward))


def learner(states: Versions, reward: Column, name: str = "feedback") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: each batch of feedback makes one version, however often it comes."""

    def learn(batch: DataFrame, number: int) -> None:
        states.append(lambda: adapted(proposed(states.read(), gradients(batch, reward))), f"{name}-{number}")

    return learn
