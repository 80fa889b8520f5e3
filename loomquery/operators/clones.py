"""Duplicate and clone detection in collections of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import masked_environment
from loomquery.sources.stored import stored

MOST_LITERALS = 50_000


def exact_duplicates(files: DataFrame, key: str, text: str) -> DataFrame:
    """digest, copies, first_key of every text that occurs more than once; only digests are shuffled."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    return files.select(key, digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key")).filter("copies > 1")


def environment_forks(files: DataFrame, key: str, text: str) -> DataFrame:
    """digest, copies, first_key of texts that differ, but only in what is masked as environment."""
    own = files.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("raw"), F.sha2(masked_environment(F.coalesce(F.col(text), F.lit(""))), 256).alias("digest"))
    classes = own.groupBy("digest", "raw").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
    return classes.groupBy("digest").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("variants"), F.min("first_key").alias("first_key")).filter("variants > 1")


def significant_lines(text: Column) -> Column:
    """Trimmed lines without trailing comments and blank ones, as (line number from 1, line)."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("no"), F.trim(F.regexp_replace(x, r"\s+#.*$", "")).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def blocks(files: DataFrame, key: str, text: str, lines: int = 6) -> DataFrame:
    """key, at (position among significant lines), line_no, block (a digest of ``lines`` lines)."""
    own = files.select(F.col(key).alias("key"), significant_lines(F.col(text)).alias("s"))
    each = own.select("key", "s", F.posexplode(F.when(F.size("s") >= lines, F.transform(F.slice("s", F.lit(1), F.size("s") - lines + 1), lambda x: x["no"]))).alias("at", "line_no"))
    return each.select("key", "at", "line_no", F.xxhash64(F.transform(F.slice("s", F.col("at") + 1, F.lit(lines)), lambda x: x["line"])).alias("block"))


def clone_runs(files: DataFrame, key: str, text: str, lines: int = 6) -> DataFrame:
    """key, start_line, source_key, source_start, n_lines: every stretch that repeats lines of an earlier file.

    A block's occurrences are compared with its first one only: each later file
    is tied to the file that has the block first, so a block that occurs in n
    files gives n - 1 rows and not n * n. Neighbouring blocks with the same
    source and offset are one run.
    """
    own = blocks(files, key, text, lines)
    first = own.groupBy("block").agg(F.min(F.struct("key", "at", "line_no")).alias("first"), F.min("key").alias("_least"), F.max("key").alias("_most")).filter("_least < _most")
    pairs = own.join(first.select("block", "first"), "block").filter("key <> first.key")
    pairs = pairs.select("key", "at", "line_no", F.col("first.key").alias("source_key"), F.col("first.line_no").alias("source_line"), (F.col("at") - F.col("first.at")).alias("offset"))
    by = Window.partitionBy("key", "source_key", "offset").orderBy("at")
    island = F.col("at") - F.row_number().over(by)
    return pairs.withColumn("island", island).groupBy("key", "source_key", "offset", "island").agg(F.min("line_no").alias("start_line"), F.min("source_line").alias("source_start"), (F.count(F.lit(1)) + lines - 1).alias("n_lines")).drop("offset", "island")


def text_classes(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, representative: the smallest key with the same text."""
    own = files.select(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    return own.join(own.groupBy("digest").agg(F.min("key").alias("representative")), "digest").select("key", "representative")


def representatives(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, text of one file of each distinct text."""
    first = text_classes(files, key, text).filter("key = representative").select("key")
    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).join(first, "key", "left_semi")


def block_members(files: DataFrame, key: str, text: str, lines: int = 6) -> DataFrame:
    """block, key, at, line_no: every place of each block that two distinct texts hold, copies folded to their representative."""
    own = blocks(representatives(files, key, text), "key", "text", lines)
    shared = own.groupBy("block").agg(F.min("key").alias("_least"), F.max("key").alias("_most")).filter("_least < _most")
    return own.join(shared.select("block"), "block", "left_semi").select("block", "key", "at", "line_no")


def clone_pairs(files: DataFrame, key: str, text: str, lines: int = 6) -> DataFrame:
    """key, start_line, source_key < key, source_start, n_lines: the maximal runs of lines that two distinct texts share.

    Every place of a block meets every other one of another text, so no link
    depends on which file came first; n texts with one block give n (n - 1) / 2
    rows, as many as there are links. ``text_classes`` has the copies.
    """
    own = block_members(files, key, text, lines)
    source = own.select("block", F.col("key").alias("source_key"), F.col("at").alias("source_at"), F.col("line_no").alias("source_line"))
    pairs = own.join(source, "block").filter("source_key < key").withColumn("offset", F.col("at") - F.col("source_at"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("key", "source_key", "offset").orderBy("at"))
    return pairs.withColumn("island", island).groupBy("key", "source_key", "offset", "island").agg(F.min("line_no").alias("start_line"), F.min("source_line").alias("source_start"), (F.count(F.lit(1)) + lines - 1).alias("n_lines")).drop("offset", "island")


def clone_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("clones"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("lines"), F.countDistinct("key").alias("files"))


def with_shingles(texts: DataFrame, text: str, name: str, words: int = 5, among: list[int] | None = None) -> DataFrame:
    """Adds an array of distinct hashes of all runs of words (or of those ``among`` the given ones); a shorter text is one run.

    The words are a column of their own first: inside the run's expression they would be split anew for every run.
    """
    own = f"{name}_words"
    split = texts.withColumn(own, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    w = F.col(own)
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
    if among is not None:
        runs = F.filter(runs, lambda x: x.isin(among))
    found = F.when(F.size(w) >= words, F.array_distinct(runs)).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))
    return split.withColumn(name, found).drop(own)


def passages_contained(texts: DataFrame, text_key: str, text: str, passages: DataFrame, passage_key: str, passage: str, least: float) -> DataFrame:
    """text_id, passage, containment: which texts hold at least that share of a passage's five-word runs.

    Up to MOST_LITERALS runs of all passages become literals, by which a text's
    runs are sieved in the row, so that only those leave it that can match. More
    passages meet all runs by their hash. The outer form of explode keeps the
    optimizer from computing the runs twice to test that there are any.
    """
    p = with_shingles(passages.select(F.col(passage_key).alias("passage"), F.col(passage).alias("own")), "own", "s")
    runs = stored(p.select("passage", F.size("s").alias("size"), F.explode_outer("s").alias("run")).filter("run is not null"), "passage-runs")
    known = [r["run"] for r in runs.select("run").distinct().limit(MOST_LITERALS + 1).collect()]
    t = with_shingles(texts.select(F.col(text_key).alias("text_id"), F.col(text).alias("own")), "own", "s", among=known if len(known) <= MOST_LITERALS else None)
    own = t.select("text_id", F.explode_outer("s").alias("run")).filter("run is not null")
    return own.join(runs, "run").groupBy("text_id", "passage").agg((F.count(F.lit(1)) / F.first("size")).alias("containment")).filter(F.col("containment") >= least)


