"""Shaping of results: defaults, pages, compact and one-line forms, groups and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import headline


def first_of(*values: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    found = [F.nullif(v, F.lit("")) for v in values]
    return F.coalesce(*found, *([F.lit(default)] if default is not None else [F.lit(None).cast("string")]))


def consistent(hits: DataFrame) -> DataFrame:
    """Every field has a value: an id made of path and line where it is missing, lines from 1, relevance from 0."""
    start = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)))
    return hits.withColumns(
        {
            "id": first_of(F.col("id"), F.concat_ws(":", "file_path", start.cast("string"))),
            "file_path": F.coalesce("file_path", F.lit("")),
            "start_line": start,
            "end_line": F.greatest(start, F.coalesce("end_line", start)),
            "relevance": F.greatest(F.lit(0.0), F.coalesce("relevance", F.lit(0.0))),
        }
    )


def page(hits: DataFrame, take: int, skip: int, *order: Column, query_col: str = "query_id") -> DataFrame:
    """The hits of one page with position, total, has_more and next_skip (null on the last page)."""
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(*order)).cast("long")
    # The rank filter lets each task drop all but its first rows; totals are counted apart, without a window.
    first = hits.withColumn("position", place).filter(F.col("position") <= skip + take).filter(F.col("position") > skip)
    total = hits.groupBy(F.col(query_col).alias("_key")).agg(F.count(F.lit(1)).alias("total"))
    more = F.col("total") > skip + take
    found = first.join(total, F.col(query_col).eqNullSafe(F.col("_key"))).drop("_key")
    return found.withColumn("has_more", more).withColumn("next_skip", F.when(more, F.lit(skip + take).cast("long")))


def compact(content: Column, path: Column, line: Column, score: Column) -> Column:
    """path:line, a headline and a score with four decimals (half to even)."""
    return F.struct(F.concat_ws(":", path, line.cast("string")).alias("at"), headline(content).alias("headline"), F.bround(score, 4).alias("score"))


def one_line(content: Column, path: Column, line: Column, score: Column) -> Column:
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(" | "), headline(content, 57), F.lit(" | "), F.format_string("%.2f", score))


def relevance_bucket(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("low")


def grouped(hits: DataFrame, group: Column, score: Column, id_col: str, most: int = 10) -> DataFrame:
    """group, n, best (the ids of the ``most`` best hits, in order)."""
    own = hits.select(group.alias("group"), score.alias("score"), id_col)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), id_col))
    best = own.withColumn("place", place).filter(F.col("place") <= most).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", id_col))).alias("b"))
    counted = own.groupBy(F.col("group").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return best.join(counted, F.col("group").eqNullSafe(F.col("_key"))).select("group", "n", F.col(f"b.{id_col}").alias("best"))


def confidence(hits: DataFrame, score: str, query_col: str = "query_id") -> DataFrame:
    """query_id, confidence: the mean of the five best scores, raised when there are many hits and lowered when there are few; 1 at most."""
    place = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc(score)))
    best = hits.select(query_col, score).withColumn("_n", place).filter("_n <= 5").groupBy(query_col).agg(F.avg(score).alias("mean"))
    counted = hits.groupBy(F.col(query_col).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    scale = F.when(F.col("n") >= 10, 1.2).when(F.col("n") >= 5, 1.0).otherwise(0.8)
    return best.join(counted, F.col(query_col).eqNullSafe(F.col("_key"))).select(query_col, F.least(F.lit(1.0), F.col("mean") * scale).alias("confidence"))
