"""The most similar texts of each of many: top-k by Jaccard similarity, counted text by text against all queries at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.operators.near import shingle_sets
from loomquery.sources.stored import stored

GROUP_SHINGLES = 1 << 21  # of queries that are broadcast at once; the texts are read again for each such group
CELLS = 1 << 22  # counts, and shared shingles, that a task has at once
FIRST = 8  # a task that holds so many times k hits of each query drops those that can't be among its best
MOST_BITS = 27  # the queries' shingles are told by a bitmap of at most so many bits (16 MB); beyond, more others pass it


def asked_only(shingles: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Whether each shingle may be one of ``shingles`` (a column shingle, distinct): never false for one that is."""
    bits = min(MOST_BITS, max(16, (16 * shingles.count()).bit_length()))
    # A word of 64 bits for each slot that is set: as many rows as shingles at most, and 2^21 in all.
    slot = F.col("shingle").bitwiseAND((1 << bits) - 1)
    words = shingles.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 as int))")).alias("set")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64)
    shared = shingles.sparkSession.sparkContext.broadcast(bitmap)

    def told(x: np.ndarray) -> np.ndarray:
        return (shared.value[(x & ((1 << bits) - 1)) >> 6] >> (x & 63)) & 1 == 1

    return told


def most_similar(files: DataFrame, is_query: Column, k: int, key: str, text: str, words: int = 5) -> DataFrame:
    """query_key, rank, other_key, similarity: the k texts whose sets of ``words``-word shingles are most similar to each query's, exactly.

    Only shingles of queries make texts meet, so only these are kept of a text,
    told by a bitmap. Sets are never shuffled: what two have in common is
    counted on the kept shingles. Of texts that keep the same ones, only the
    k + 1 smallest can be among a query's k.

    Queries are broadcast, group by group, as lists of queries by shingle. A
    task counts what each of its texts has in common with all of them, so that
    no pair is a row, and answers with k texts for each query at most.

    A text with the same set as others is one candidate, under the smallest of
    their keys; the query's own set is none. Texts that share no shingle are not
    listed, so that a query may have less than k rows; ties go to the smaller
    key. Null texts and texts without a word take no part.
    """
    ask = F.coalesce(is_query, F.lit(False))
    asks = stored(shingle_sets(files.filter(ask).select(key, text), key, text, words), "similar-asks")
    told = asked_only(asks.select(F.explode("s").alias("shingle")).distinct())

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.asarray(s, np.int64) for s in batch["s"]]
            yield pd.DataFrame({"key": batch["key"], "set_id": batch["set_id"], "m": np.fromiter(map(len, sets), np.int32, len(sets)), "s": [s[told(s)] for s in sets]})

    every = shingle_sets(files.select(key, text), key, text, words)
    kind = every.schema["key"].dataType.simpleString()
    rows = stored(every.mapInPandas(kept, f"key {kind}, set_id string, m int, s array<long>"), "similar-sets")
    one = rows.groupBy("set_id").agg(F.min("key").alias("id"), F.first("m").alias("m"), F.first("s").alias("s"))
    marked = asks.select("set_id", F.lit(True).alias("asked")).distinct()
    sets = stored(one.join(marked, "set_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "similar-texts")
    queries = asks.select(F.col("key").alias("query_key"), "set_id").distinct().join(sets.filter("asked").select("set_id", "id"), "set_id").select("query_key", "id")

    # Shingles of one set only meet nothing and are not kept.
    each = sets.select("id", "m", "asked", F.explode("s").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.bool_or("asked").alias("known")).filter("known and n > 1").select("shingle")
    met = stored(each.join(counts, "shingle").groupBy("id", "m", "asked").agg(F.sort_array(F.collect_list("shingle")).alias("s")).filter("id is not null"), "similar-met")
    # Of texts that keep the same shingles a query finds the smallest sets most similar: k of them, and one more as it may be one itself.
    alike = F.row_number().over(Window.partitionBy(F.sha2(F.array_join("s", ","), 256)).orderBy("m", "id"))
    others = stored(met.withColumn("nth", alike).filter(F.col("nth") <= k + 1).select(F.col("id").alias("other"), F.col("m").alias("other_m"), F.col("s").alias("b")), "similar-others")
    asking = met.filter("asked")
    total = asking.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / GROUP_SHINGLES))
    found = None
    for g in range(groups):
        own = asking.filter(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).select("id", "m", "s")
        best = most_common(own, others, k, kind)
        found = best if found is None else found.unionByName(best)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    found = found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
    return queries.join(found, "id").select("query_key", "rank", F.col("other").alias("other_key"), "similarity")


def most_common(own: DataFrame, others: DataFrame, k: int, kind: str) -> DataFrame:
    """id, other, similarity: of each task the k best of ``others`` (other, other_m, b) for each of the queries (id, m, s), which fit a broadcast."""
    rows = own.toArrow()
    sizes = np.array([len(s) for s in rows["s"]], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *[s.values.to_numpy() for s in rows["s"]]])
    by_shingle = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[by_shingle], return_index=True)
    lists = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_shingle]
    ids = rows["id"].combine_chunks()
    shared = own.sparkSession.sparkContext.broadcast((names, np.append(starts, len(flat)), lists, rows["m"].to_numpy().astype(np.int64), ids.to_numpy(zero_copy_only=False)))

    def top(query: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query in order, and the place of each."""
        order = np.lexsort((np.unique(other, return_inverse=True)[1], -similarity, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[place < k]
        return query[place < k], other[keep], similarity[keep], place[place < k]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, lists, m, keys = shared.value
        n, bars, held = len(m), np.zeros(len(m)), []

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            query, other, similarity, place = top(*map(np.concatenate, zip(*held)))
            bars[query[place == k - 1]] = similarity[place == k - 1]
            return query, other, similarity

        for batch in batches:
            other, other_m = batch.column("other").to_numpy(zero_copy_only=False), batch.column("other_m").to_numpy().astype(np.int64)
            sets = batch.column("b")
            text = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            flat = sets.flatten().to_numpy()
            at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
            here = names[at] == flat if len(names) else np.zeros(len(flat), bool)
            text, at = text[here], at[here]
            size = starts[at + 1] - starts[at]
            ends, low = np.cumsum(size), 0
            while low < len(text):  # some texts at once: whole ones, and one at least
                most = np.searchsorted(text, text[low] + max(1, CELLS // n))
                most = min(most, np.searchsorted(text, text[min(np.searchsorted(ends, ends[low] - size[low] + CELLS), len(text) - 1)]))
                high = max(most, np.searchsorted(text, text[low], "right"))
                own = size[low:high]
                which = np.arange(own.sum()) + np.repeat(starts[at[low:high]] - np.cumsum(own) + own, own)
                common = np.bincount(np.repeat(text[low:high] - text[low], own) * n + lists[which])
                pair = np.flatnonzero(common)
                common, query, of = common[pair], pair % n, pair // n + text[low]
                similarity = common / (m[query] + other_m[of] - common)
                good = (similarity >= bars[query]) & (keys[query] != other[of])
                held.append((query[good], other[of[good]], similarity[good]))
                if sum(len(x[0]) for x in held) > FIRST * k * n:
                    held[:] = [best()]
                low = high
        if held:
            query, other, similarity = best()
            yield pa.RecordBatch.from_pydict({"id": pa.array(keys[query], ids.type), "other": pa.array(other, ids.type), "similarity": similarity})

    return others.mapInArrow(count, f"id {kind}, other {kind}, similarity double")
