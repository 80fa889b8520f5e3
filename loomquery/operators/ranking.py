"""Contextual ranking: eight factors with confidences, weighted by intent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import jaccard, keywords, unit_range

FACTORS = ["text_relevance", "semantic_similarity", "context_overlap", "import_similarity", "proximity_score", "recency_score", "quality_score", "pattern_match"]
# The factors' weights for each intent, in the order of FACTORS.
WEIGHTS = {
    "implement": [0.15, 0.25, 0.10, 0.15, 0.05, 0.05, 0.20, 0.05],
    "debug": [0.30, 0.15, 0.15, 0.05, 0.10, 0.15, 0.05, 0.05],
    "understand": [0.10, 0.35, 0.10, 0.05, 0.15, 0.05, 0.15, 0.05],
    "refactor": [0.15, 0.15, 0.10, 0.15, 0.20, 0.05, 0.15, 0.05],
    "test": [0.20, 0.10, 0.10, 0.10, 0.25, 0.05, 0.15, 0.05],
    "document": [0.15, 0.30, 0.05, 0.05, 0.10, 0.10, 0.20, 0.05],
}


def factor(value: Column, confidence: Column | float) -> Column:
    return F.struct(value.cast("double").alias("value"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"))


def minmax(value: Column, *by: str) -> Column:
    """Within a query's hits; no spread is neutral."""
    w = Window.partitionBy(*by)
    return unit_range(value, F.min(value).over(w), F.max(value).over(w))


def semantic_similarity(cross_encoder: Column, reranker: Column, vector: Column, text: Column, query: Column) -> Column:
    """The best signal there is, with its confidence: cross encoder, reranker, vector, shared keywords, none."""
    one, zero = F.lit(1.0), F.lit(0.0)
    a, b = keywords(text), keywords(query)
    return (
        F.when(cross_encoder.isNotNull(), factor(unit_range(cross_encoder, zero, one), 1.0))
        .when(reranker.isNotNull(), factor(unit_range(reranker, zero, one), 0.9))
        .when(vector.isNotNull(), factor(unit_range(vector, zero, one), 0.8))
        .when((F.size(a) > 0) & (F.size(b) > 0), factor(jaccard(a, b), 0.6))
        .otherwise(factor(zero, 0.3))
    )


def context_overlap(imports: Column, own_imports: Column, functions: Column, dependencies: Column, same_framework: Column, same_language: Column) -> Column:
    """Shares of the context that the hit has, over the weights of the parts that could be compared."""

    def share(context: Column, hit: Column) -> tuple[Column, Column]:
        there = (F.coalesce(F.size(context), F.lit(0)) > 0) & (F.coalesce(F.size(hit), F.lit(0)) > 0)
        return F.when(there, 0.3 * F.size(F.array_intersect(context, hit)) / F.size(F.array_distinct(context))).otherwise(0.0), F.when(there, 0.3).otherwise(0.0)

    parts = [share(imports, own_imports), share(functions, dependencies)]
    parts += [(F.when(same, 0.2).otherwise(0.0), F.when(same, 0.2).otherwise(0.0)) for same in (same_framework, same_language)]
    value = parts[0][0] + parts[1][0] + parts[2][0] + parts[3][0]
    weight = parts[0][1] + parts[1][1] + parts[2][1] + parts[3][1]
    return F.when(weight > 0, value / weight).otherwise(0.0)


def quality(explicit: Column, coverage: Column, complexity: Column, has_caption: Column, has_test_tag: Column) -> Column:
    """The explicit score, else the mean of what is known; confidence adds up."""
    zero, one = F.lit(0.0), F.lit(1.0)
    signals = F.filter(
        F.array(
            F.when(coverage.isNotNull(), F.struct(unit_range(coverage, zero, one).alias("v"), F.lit(0.3).alias("c"))),
            F.when(complexity.isNotNull(), F.struct((1 - unit_range(complexity, zero, F.lit(50.0))).alias("v"), F.lit(0.2).alias("c"))),
            F.when(has_caption, F.struct(F.lit(0.7).alias("v"), F.lit(0.2).alias("c"))),
            F.when(has_test_tag, F.struct(F.lit(0.8).alias("v"), F.lit(0.1).alias("c"))),
        ),
        lambda x: x.isNotNull(),
    )
    total = F.aggregate(signals, F.lit(0.0), lambda s, x: s + x["v"]) / F.size(signals)
    sure = F.least(F.lit(1.0), F.aggregate(signals, F.lit(0.0), lambda s, x: s + x["c"]))
    return F.when(explicit.isNotNull(), factor(unit_range(explicit, zero, one), 0.8)).when(F.size(signals) > 0, factor(total, sure)).otherwise(factor(F.lit(0.3), 0.3))


def weights_table(spark, adjustments: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """intent, factor, weight; adjusted weights are held in [0.05, 0.5] and made to add up to 1."""
    rows = F.array(*[F.struct(F.lit(i).alias("intent"), F.lit(f).alias("factor"), F.lit(w + (adjustments or {}).get(i, {}).get(f, 0.0)).alias("weight")) for i, ws in WEIGHTS.items() for f, w in zip(FACTORS, ws)])
    table = spark.range(1).select(F.inline(rows))
    if not adjustments:
        return table
    held = table.withColumn("weight", F.greatest(F.lit(0.05), F.least(F.lit(0.5), F.col("weight"))))
    return held.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("intent")))


def weighted_score(intent: Column) -> Column:
    """Sum of value * weight * confidence over sum of weight * confidence, of columns named by FACTORS."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for i, name in enumerate(FACTORS):
        weight = F.lit(0.0)
        for key, ws in WEIGHTS.items():
            weight = F.when(intent == key, ws[i]).otherwise(weight)
        top = top + F.col(name)["value"] * weight * F.col(name)["confidence"]
        bottom = bottom + weight * F.col(name)["confidence"]
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def explanation(intent: Column, top: int = 3, least: float = 0.01) -> Column:
    """The factors that contributed most."""
    parts = []
    for i, name in enumerate(FACTORS):
        weight = F.lit(0.0)
        for key, ws in WEIGHTS.items():
            weight = F.when(intent == key, ws[i]).otherwise(weight)
        parts.append(F.struct((F.col(name)["value"] * weight * F.col(name)["confidence"]).alias("part"), F.lit(name).alias("name")))
    best = F.slice(F.filter(F.sort_array(F.array(*parts), asc=False), lambda x: x["part"] > least), 1, top)
    return F.concat_ws(", ", F.transform(best, lambda x: F.format_string("%s: %.2f", x["name"], x["part"])))


def rank_order(scored: DataFrame) -> DataFrame:
    """By score, then the score before ranking, then shorter text, then path, then id."""
    order = [F.desc("score"), F.desc("original"), F.asc("length"), F.desc("path"), F.asc("id")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def metrics(scored: DataFrame, score: str = "score") -> DataFrame:
    """One row: counts, mean, population variance, scores that tie at four decimals, five buckets."""
    s = F.col(score)
    bucket = F.when(s < 0.2, 0).when(s < 0.4, 1).when(s < 0.6, 2).when(s < 0.8, 3).otherwise(4)
    by_score = scored.filter(s.isNotNull()).groupBy(F.round(s, 4).alias("rounded")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("total"), F.sum(s * s).alias("squares"), F.count_if(s > 0.5).alias("filtered"), *[F.count_if(bucket == i).alias(f"b{i}") for i in range(5)]
    )
    mean = F.sum("total") / F.sum("n")
    return by_score.agg(
        F.sum("n").alias("total_results"),
        F.sum("filtered").alias("filtered_count"),
        mean.alias("average_score"),
        (F.sum("squares") / F.sum("n") - mean * mean).alias("score_variance"),
        F.count_if(F.col("n") > 1).alias("tie_count"),
        *[F.sum(f"b{i}").alias(f"bucket_{i}") for i in range(5)],
    )


def ndcg(hits: DataFrame, query: str, order: list[str], gain: str, k: int) -> DataFrame:
    """query, ndcg: the discounted gain of the first k hits against that of the best order of all; 0 where nothing has a gain.

    Gains are 2^g - 1 over log2(place + 1). Only the first k rows of either
    order leave a task.
    """
    place = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(gain), *order))

    def total(at: Column) -> DataFrame:
        own = hits.withColumn("_at", at).filter(F.col("_at") <= k)
        return own.groupBy(query).agg(F.sum((F.pow(F.lit(2.0), F.col(gain)) - 1) / F.log2(F.col("_at") + 1)).alias("d"))

    both = total(place).join(total(ideal).withColumnsRenamed({"d": "best", query: "_q"}), F.col(query).eqNullSafe(F.col("_q")))
    return both.select(query, F.when(F.col("best") > 0, F.col("d") / F.col("best")).otherwise(0.0).alias("ndcg"))
