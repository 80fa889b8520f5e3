"""SimHash fingerprints and their near-duplicate groups by anchor-point covering."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.llm import golay
from loomquery.llm.common import cut, words

BITS = 64


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text: a bit is set if over half of the shingle hashes set it."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    span = min(shingle, len(w))
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(w) - span + 1, 1 << 16):  # blocks, so that a giant text needs little memory
        stop = min(at + (1 << 16), len(w) - span + 1)
        h = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at:stop], ends[at + span - 1 : stop + span - 1])], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = 2 * set_bits > len(w) - span + 1
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, mark: Column | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and mark of every row."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return df.select(F.col(id_col).cast("long").alias("doc_id"), simhash(F.col(text_col).cast("string")).alias("fp"), (F.lit(None) if mark is None else mark).cast("string").alias("mark"))


def anchored(fps: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """anchor, fp, home: each fingerprint at every anchor within the covering radius plus ``threshold``.

    An anchor is one Golay codeword for each of the first ``blocks`` 23-bit
    stretches of a fingerprint (the third stretch has 18 bits, padded with
    zeros). In each stretch exactly one codeword lies within radius 3: together
    they are the fingerprint's home. A fingerprint that differs in e bits of a
    stretch lies within 3 + e of that codeword, so one at distance d <= threshold
    overall reaches the home by excesses that add up to at most d.
    """
    tables = [golay.patterns(e) for e in range(threshold + 1)]
    excesses = [e for e in itertools.product(range(threshold + 1), repeat=blocks) if sum(e) <= threshold]

    def replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                fp = whole["fp"].to_numpy()[at : at + 2048]
                bits = fp.view(np.uint64)
                parts = [(bits >> np.uint64(golay.LENGTH * b) & np.uint64((1 << golay.LENGTH) - 1)).astype(np.int64) for b in range(blocks)]
                found = [golay.syndromes(p) for p in parts]
                for excess in excesses:
                    key, there = np.zeros((len(fp), 1), np.int64), np.ones((len(fp), 1), bool)
                    for part, of, e in zip(parts, found, excess):
                        errors = tables[e][of]
                        codeword = (part[:, None] ^ errors) >> golay.CHECK_BITS  # the message bits name it
                        key = (key[:, :, None] << 12 | codeword[:, None, :] & 0xFFF).reshape(len(fp), -1)
                        there = (there[:, :, None] & (errors >= 0)[:, None, :]).reshape(len(fp), -1)
                    row, column = np.nonzero(there)
                    yield pd.DataFrame({"anchor": key[row, column], "fp": fp[row], "home": sum(excess) == 0})

    return fps.select("fp").mapInPandas(replicate, "anchor long, fp long, home boolean")


def links(fps: DataFrame, threshold: int = 2, blocks: int = 2) -> DataFrame:
    """u < v: every pair of different fingerprints that differ in at most ``threshold`` bits, once.

    ``fps`` must hold distinct values. Of a pair, u is looked for at its one
    home and v at all its anchors, so no pair is made twice and none is missed.
    More blocks make more, smaller buckets of more copies (2: 2^24 anchors and
    about 60 copies; 3: 2^36 and about 120); the links are the same.
    """
    copies = anchored(fps, threshold, blocks)
    home = copies.filter("home").select("anchor", F.col("fp").alias("u")).hint("shuffle_hash")
    away = copies.select("anchor", F.col("fp").alias("v"))
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= threshold)
    return away.join(home, (away["anchor"] == home["anchor"]) & near).select("u", "v")


def stars(edges: DataFrame) -> DataFrame:
    """Connected components: node, root (the smallest node it reaches) for every node that isn't a root.

    Alternates the two star operations on edge tables (u < v): every larger,
    then every smaller neighbour of a node is tied to the smallest one known.
    Only minima are aggregated, never neighbour lists, and each round's table is
    written to the shared folder. Rounds grow with the logarithm of the longest
    path.
    """
    now = cut(edges.select("u", "v").distinct(), "star-edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == before or not state[0]:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.filter("v > u").join(low, "u").select(F.col("low").alias("u"), "v").distinct()
        large = cut(large, "star-large")
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.col("low").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a <> b")
        now = cut(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "star-small")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2, blocks: int | None = None, mark: Column | None = None) -> DataFrame:
    """Group rows whose SimHash fingerprints link, directly or through others.

    Rows of one fingerprint are one class from the start; links are sought
    between distinct fingerprints only, and their components are found on the
    cluster. Without ``blocks`` the number of distinct fingerprints decides
    (2 up to 2^26, else 3); either gives the same groups.

    Returns one row per input row: doc_id, fp (signed 64 bits), component_id
    (the smallest doc_id of the group), root (the group's own key, also where no
    row of it has an id), mark (an expression over df to tell rows by, or null).

    Null and blank texts have fingerprint zero, linked like any other. Texts
    shorter than a shingle count as one shingle. Null ids are kept and never
    become a component_id unless a whole group has none; repeated rows are
    returned as often as they occur. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = cut(fingerprints(df, id_col, text_col, shingle, mark), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    if blocks is None:
        blocks = 2 if classes.count() <= 1 << 26 else 3
    star = stars(links(classes.select("fp"), threshold, blocks))
    rooted = classes.join(star, classes["fp"] == star["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(star.select("root").distinct(), "root", "left_semi")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root", "left").select("fp", "root", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root", "mark")
