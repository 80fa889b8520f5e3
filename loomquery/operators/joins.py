"""Joins around results: hits to documents and stages, shown to selected, records to ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.sources.stored import stored


def with_documents(hits: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Hits (query_id, id, score) with the columns of their documents; hits without a document go."""
    return hits.join(docs.withColumnRenamed(id_col, "id"), "id")


def with_stages(fused: DataFrame, staged: DataFrame) -> DataFrame:
    """Fused hits with what the stages knew: stages (in order), first_stage, and original, the first stage's score that is not 0.

    ``staged`` has query_id, stage, id, score. A hit no stage knows keeps its fused score as original.
    """
    known = staged.groupBy("query_id", "id").agg(
        F.sort_array(F.collect_set("stage")).alias("stages"),
        F.min("stage").alias("first_stage"),
        F.min_by("score", F.when(F.col("score") != 0, F.col("stage"))).alias("_first"),
    )
    return fused.join(known, ["query_id", "id"], "left").withColumn("original", F.coalesce("_first", "score")).drop("_first")


def selected_of(shown: DataFrame, selected: DataFrame, on: list[str]) -> DataFrame:
    """The shown results that were selected."""
    return shown.join(selected.select(*on).distinct(), on, "left_semi")


def with_latest(records: DataFrame, ratings: DataFrame, on: str, order: list[str], value: str, name: str) -> DataFrame:
    """Records with the newest rating of their key, null if there is none. Ratings are reduced to one a key first."""
    newest = ratings.groupBy(on).agg(F.max_by(value, F.struct(*order)).alias(name))
    return records.join(newest, on, "left")


def same_name_pairs(items: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """group, key, other, name: items of one group that share a name, each with each other one."""
    other = items.select(group, F.col(key).alias("other"), name)
    return items.select(group, key, name).join(other, [group, name]).filter(F.col(key) != F.col("other"))


def siblings(files: DataFrame, key: str, directory: Column) -> DataFrame:
    """key, directory, siblings (files beside it), before and after (its neighbours by key); counts and neighbours, not all pairs.

    Files are put in order by ranges of (directory, key), so a large directory
    spreads over several; the first and the last file of each range find their
    neighbours by what the ranges beside it begin and end with. Keys are there
    and differ within a directory.
    """
    own = files.select(F.col(key).alias("_key"), directory.alias("directory"))
    placed = stored(own.repartitionByRange("directory", "_key").withColumn("_part", F.spark_partition_id()), "siblings")
    parts = placed.groupBy("directory", "_part").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.count(F.lit(1)).alias("_n"))
    among = Window.partitionBy("directory").orderBy("_part")
    ends = parts.select(F.col("directory").alias("_directory"), F.col("_part").alias("_of"), F.lag("_high").over(among).alias("_before"), F.lead("_low").over(among).alias("_after"), (F.sum("_n").over(Window.partitionBy("directory")) - 1).alias("siblings"))
    inside = Window.partitionBy("directory", "_part").orderBy("_key")
    near = placed.withColumns({"before": F.lag("_key").over(inside), "after": F.lead("_key").over(inside)})
    joined = near.join(ends, F.col("directory").eqNullSafe(F.col("_directory")) & (F.col("_part") == F.col("_of")))
    return joined.select(F.col("_key").alias(key), "directory", F.coalesce("before", "_before").alias("before"), F.coalesce("after", "_after").alias("after"), "siblings")


def first_existing(wanted: DataFrame, key: str, base: str, files: DataFrame, path: str, endings: list[str]) -> DataFrame:
    """key, resolved: of the paths that ``base`` makes with the endings, in their order, the first that exists; others go."""
    tried = wanted.select(key, F.posexplode(F.array(*[F.concat(F.col(base), F.lit(e)) for e in endings])).alias("place", "_path"))
    found = tried.join(files.select(F.col(path).alias("_path")).distinct(), "_path")
    return found.groupBy(key).agg(F.min_by("_path", "place").alias("resolved"))


def apply_changes(base: DataFrame, changes: DataFrame, key: str, order: list[str], removed: Column) -> DataFrame:
    """The table after a feed of changes: each key's newest change counts; ``removed`` tells that it deletes the row.

    ``changes`` has the columns of ``base`` and those of ``order``.
    """
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in base.columns], removed.alias("_removed")), F.struct(*order)).alias("_new"))
    kept = base.join(newest.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(newest.filter("not _new._removed").select(*[F.col(f"_new.{c}").alias(c) for c in base.columns]))
