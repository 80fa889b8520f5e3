"""Lexical and vector retrieval for batches of queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import tokens
from loomquery.sources.stored import stored

K1, B = 1.2, 0.75
#: Up to this many distinct terms of a batch become literals that sieve a text's words in its row; more are met by shuffle.
LITERAL_TERMS = 2_000


def occurrences(docs: DataFrame, id_col: str, fields: dict[str, float], known: list[str] | None) -> DataFrame:
    """id, field, dl (tokens in the field), words: one row per document and field; ``words`` only the known ones, if they are given."""
    split = docs.select(F.col(id_col).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("words")) for f in fields])))
    words = F.col("words") if known is None else F.filter("words", lambda w: w.isin(known))
    return split.select("id", "field", F.size("words").alias("dl"), words.alias("words"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B, fields: dict[str, float] | None = None) -> DataFrame:
    """query_id, id, score: BM25 of every document that shares a term with a query.

    ``queries`` has query_id and text. With ``fields`` (column: weight) the score
    is the weighted sum over several columns, each with lengths and frequencies
    of its own. Texts are tokenised once: what a document has of the asked terms
    is stored with its length, and all statistics come from there.
    """
    fields = fields or {text_col: 1.0}
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    known = [r[0] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    few = len(known) <= LITERAL_TERMS
    met = stored(occurrences(docs, id_col, fields, known if few else None), "occurrences")
    stats = {r["field"]: r for r in met.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).collect()}
    # The outer form keeps the optimizer from testing the array's size with a copy of its expression.
    each = met.select("id", "field", "dl", "words", F.explode_outer(F.array_distinct("words")).alias("term")).filter("term is not null")
    found = each.select("id", "field", "dl", "term", F.size(F.filter("words", lambda w: w == F.col("term"))).alias("tf"))
    if not few:
        found = found.join(asked.select("term").distinct(), "term", "left_semi")

    def of_field(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("field")]

    n = of_field({f: stats[f]["n"] if f in stats else 0 for f in fields})
    avgdl = of_field({f: float(stats[f]["avgdl"] or 0) or 1.0 if f in stats else 1.0 for f in fields})
    df = found.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * of_field({f: float(w) for f, w in fields.items()})
    weighed = asked.join(df, "term").withColumn("idf", idf)
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    return found.join(weighed, ["field", "term"]).groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def top_per_query(hits: DataFrame, k: int, *order: Column, query_col: str = "query_id") -> DataFrame:
    """The first k hits of each query with their rank from 1."""
    order = order or (F.desc("score"), F.col("id"))
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(*order))
    return hits.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def variants_union(hits: DataFrame) -> DataFrame:
    """Of a document found by several variants of a query, the hit of the first one.

    ``hits`` has query_id, variant, id, score.
    """
    return hits.groupBy("query_id", "id").agg(F.min_by("score", "variant").alias("score"), F.min("variant").alias("variant"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """query_id, id, score, rank: the k nearest by cosine, for any number of queries (query_id, q).

    Queries and candidates are dealt into blocks of about ``block`` rows and every
    pair of blocks meets in one task, which returns k rows of each query at most.
    Scores are compared at nine decimals; ties go to the smaller id. Vectors that
    are null or of length zero take no part.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("v is not null")
    q = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter("q is not null")
    by_candidate, by_query = (max(1, math.ceil(x.count() / block)) for x in (v, q))

    def dealt(vector: str, name: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(name, vector), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    candidates = v.withColumn("c", dealt("v", "id", by_candidate)).select("*", every(by_query).alias("b"))
    of = q.withColumn("b", dealt("q", "query_id", by_query)).select("*", every(by_candidate).alias("c"))
    kinds = {name: frame.schema[name].dataType.simpleString() for frame, name in ((q, "query_id"), (v, "id"))}

    def search(key: tuple, asked: pd.DataFrame, among: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": asked["query_id"][:0], "id": among["id"][:0], "score": np.zeros(0)})]
        if asked.empty or among.empty:
            return parts[0]
        x, ids = np.array(among["v"].to_list(), np.float64), among["id"].to_numpy()
        norms = np.sqrt((x * x).sum(axis=1))
        x, ids = x[norms > 0] / norms[norms > 0][:, None], ids[norms > 0]
        for at in range(0, len(asked), 256):
            y, names = np.array(asked["q"].to_list()[at : at + 256], np.float64), asked["query_id"].to_numpy()[at : at + 256]
            y_norms = np.sqrt((y * y).sum(axis=1))
            y, names = y[y_norms > 0] / y_norms[y_norms > 0][:, None], names[y_norms > 0]
            scores = y @ x.T
            for name, score in zip(names, scores):
                best = np.lexsort((ids, -np.round(score, 9)))[:k]
                parts.append(pd.DataFrame({"query_id": name, "id": ids[best], "score": score[best]}))
        return pd.concat(parts)

    found = of.groupBy("b", "c").cogroup(candidates.groupBy("b", "c")).applyInPandas(search, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return top_per_query(found, k, F.round("score", 9).desc(), F.col("id"))


def service_score(cosine: Column) -> Column:
    """A cosine as the score a search service shows."""
    return 1 / (1 + (1 - cosine))


def facets(docs: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """value, n: the most frequent values; arrays count each element."""
    values = F.explode(field) if docs.schema[field].dataType.typeName() == "array" else F.col(field)
    return docs.select(values.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def report(docs: DataFrame, *fields: str) -> DataFrame:
    """dimension, value, n for several fields in one pass."""
    sets = [[f] for f in fields]
    grouped = docs.groupingSets(sets, *fields).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(f).alias(f"_{f}") for f in fields])
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for f in fields:
        name, value = F.when(F.col(f"_{f}") == 0, f).otherwise(name), F.when(F.col(f"_{f}") == 0, F.col(f).cast("string")).otherwise(value)
    return grouped.select(name.alias("dimension"), value.alias("value"), "n")
