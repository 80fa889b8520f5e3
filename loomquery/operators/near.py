"""Near duplicates: the exact join of shingle sets by Jaccard similarity, and the stored steps it needs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.operators.clones import with_shingles
from loomquery.sources.stored import stored

#: Shingles are counted in so many slots; the counts only fix an order, so that clashes cost time and no pair.
SLOTS = 1 << 18
#: A team of more texts is dealt into parts of about so many.
SIDE = 128
#: Slots by which sets without a pair are left out; clashes let some of them pass.
ASKED = 1 << 20


def shingle_sets(files: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """key, set_id (a digest of the set), s (the sorted shingles); texts without a word take no part."""
    # Told by the text: a filter on the set would be pushed below it and split the text anew for every run.
    with_words = files.select(F.col(key).alias("key"), F.col(text).alias("own")).filter(F.col("own").rlike(r"[\p{L}\p{N}]"))
    return with_shingles(with_words, "own", "s", words).select("key", F.sort_array("s").alias("s")).withColumn("set_id", F.sha2(F.array_join("s", ","), 256))


def members(files: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """key, representative: the smallest key with the same set of shingles. Only digests are shuffled."""
    # Stored, as both sides of the join read it and a filter for nulls would be pushed into the sets.
    own = stored(shingle_sets(files, key, text, words).select("key", "set_id"), "shingle-digests")
    return own.join(own.groupBy("set_id").agg(F.min("key").alias("representative")), "set_id").select("key", "representative")


def near_pairs(files: DataFrame, key: str, text: str, least: float, words: int = 5) -> DataFrame:
    """first_key < second_key, jaccard: every pair of representatives whose sets of shingles have that similarity at least.

    A representative stands for all texts of the same set (see ``members``), so
    copies make no pairs. Sets of n and m shingles at Jaccard >= t share one of
    the first n - ceil(t n) + 1 and m - ceil(t m) + 1 under any common order;
    texts meet on these only. Rare shingles come first (by counts in slots of
    fixed number), so lines that many texts share meet last. Where two sets meet
    first, no more than what follows in both is common to them, which drops most
    pairs as they meet; sketches of the sets drop nearly all others that are less
    alike. Unlike with MinHash bands no pair is missed by chance; every pair left
    is compared exactly.
    """
    docs = stored(shingle_sets(files, key, text, words), "shingle-sets")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(np.concatenate(batch["s"].to_list()) & (SLOTS - 1), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    found = docs.select("s").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    shared = files.sparkSession.sparkContext.broadcast(counts)
    usual = counts.mean() + 3 * math.sqrt(counts.mean())

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_of = shared.value
        for batch in batches:
            parts, rare, sketches = [], [], []
            for s in batch["s"]:
                s = np.asarray(s, np.int64)
                first = len(s) - math.ceil(least * len(s) - 1e-9) + 1
                parts.append(s[np.lexsort((s, n_of[s & (SLOTS - 1)]))[:first]])
                rare.append(int((n_of[parts[-1] & (SLOTS - 1)] <= usual).sum()))
                bits = max(64, 1 << (len(s) - 1).bit_length())
                sketches.append(np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes())
            yield pd.DataFrame({"key": batch["key"], "set_id": batch["set_id"], "n": batch["s"].map(len).astype(np.int32), "head": parts, "rare": np.array(rare, np.int32), "sketch": sketches})

    kind = docs.schema["key"].dataType.simpleString()
    heads = docs.mapInPandas(prefixes, f"key {kind}, set_id string, n int, head array<long>, rare int, sketch binary")
    # Of equal sets one is left by their heads: whole sets are not shuffled for it. Written once: both sides of the join read it.
    heads = stored(heads.groupBy("set_id").agg(F.min("key").alias("id"), *[F.any_value(c).alias(c) for c in ("n", "head", "rare", "sketch")]).drop("set_id"), "shingle-heads")
    # What stands before goes along with shingles whose slot is fuller than by chance: only these can be shared by many.
    before = F.when(F.col("at") >= F.col("rare"), F.get("head", F.col("at") - 1))
    each = heads.select("id", "n", "head", "rare", F.posexplode("head").alias("at", "run")).select("id", "run", "n", (F.col("n") - F.col("at")).alias("left"), before.alias("before"))
    a, b = each.select("run", *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "left", "before")]), each.select("run", *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "left", "before")])
    most = F.least("left_a", "left_b")
    fits = (F.col("id_a") < F.col("id_b")) & (most >= least * (F.col("n_a") + F.col("n_b") - most) - 1e-6)
    # Of such a stretch that both heads share only the beginning makes a row: before what they share first they never have the same.
    begins = F.coalesce(F.col("before_a") != F.col("before_b"), F.lit(True))
    pairs = stored(a.join(b, "run").filter(fits & begins).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "near-candidates")
    pairs = stored(in_cells(pairs, heads.select("id", "n", "sketch"), sketched(least), f"a {kind}, b {kind}"), "near-sketched")
    found = in_cells(pairs, docs.select(F.col("key").alias("id"), "s"), compared(least), f"a {kind}, b {kind}, jaccard double")
    return found.select(F.col("a").alias("first_key"), F.col("b").alias("second_key"), "jaccard")


def in_cells(pairs: DataFrame, own: DataFrame, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What ``compare`` makes of pairs (a < b) and of the rows of ``own`` (id and more) that these need, cell by cell.

    A row is not sent to each of its pairs, whose number can grow with the square
    of the texts that are alike, but once to each cell of pairs. A pair belongs
    to the team of the smallest text that its first one is paired with. Small
    teams share cells; those of more than SIDE texts are dealt into parts of
    about so many, and two parts make a cell. So a cell holds a few hundred rows
    at most, and in a large team each row sent serves SIDE / 2 pairs.
    """
    lowest = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("team"))
    teams = stored(pairs.join(lowest, "a", "left").select("a", "b", F.coalesce("team", "a").alias("team")), "near-teams")
    held = stored(teams.select("team", F.explode(F.array("a", "b")).alias("id")).distinct(), "near-held")
    parts = held.groupBy("team").agg(F.ceil(F.count(F.lit(1)) / SIDE).alias("parts")).filter("parts > 1")
    cells = held.count() // SIDE + 1
    x, y = (F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b"))
    cell = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("team"), F.lit(cells))).otherwise(F.xxhash64("team", F.least(x, y), F.greatest(x, y)))
    dealt = stored(teams.join(parts, "team", "left").select(cell.alias("cell"), "a", "b"), "near-cells")
    # Most rows without a pair are told by a slot of their key; there are ASKED slots at most to broadcast.
    slot = F.pmod(F.xxhash64("id"), F.lit(ASKED)).cast("int")
    asked = own.withColumn("slot", slot).join(F.broadcast(held.select(slot.alias("slot")).distinct()), "slot", "left_semi").drop("slot")
    sent = dealt.select(F.col("cell").alias("to"), F.explode(F.array("a", "b")).alias("id")).distinct().join(asked, "id")
    return dealt.groupBy("cell").cogroup(sent.groupBy("to")).applyInPandas(compare, schema)


def sketched(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The pairs that may have that similarity, told by sketches: bit i is the parity of the shingles whose last bits are i.

    Two sketches differ in no more bits than the sets in shingles. The longer one
    is folded to the length of the other.
    """

    def compare(mine: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        known = {i: (n, 8 * len(sketch), int.from_bytes(sketch, "little")) for i, n, sketch in zip(own["id"], own["n"], own["sketch"])}
        keep = []
        for a, b in zip(mine["a"], mine["b"]):
            (n, bits, x), (m, other, y) = sorted((known[a], known[b]), key=lambda k: k[1])
            while other > bits:
                other //= 2
                y = (y & ((1 << other) - 1)) ^ (y >> other)
            keep.append((x ^ y).bit_count() <= (1 - least) / (1 + least) * (n + m) + 1e-6)
        return mine.loc[keep, ["a", "b"]]

    return compare


def compared(least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The pairs whose sets have that similarity at least, compared exactly."""

    def compare(mine: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        sizes = own["s"].map(len).to_numpy()
        # Shingles by number, so that what one set holds is marked in an array.
        numbers = np.split(np.unique(np.concatenate(own["s"].to_list()), return_inverse=True)[1], np.cumsum(sizes)[:-1])
        at = pd.Series(np.arange(len(own)), index=own["id"])
        mine = mine.sort_values("a")
        a, b = at[mine["a"]].to_numpy(), at[mine["b"]].to_numpy()
        marked, common, last = np.zeros(int(sizes.sum()), bool), np.zeros(len(mine), np.int64), -1
        for i in range(len(mine)):
            if a[i] != last:
                if last >= 0:
                    marked[numbers[last]] = False
                last = a[i]
                marked[numbers[last]] = True
            common[i] = np.count_nonzero(marked[numbers[b[i]]])
        out = mine[["a", "b"]].assign(jaccard=common / (sizes[a] + sizes[b] - common))
        return out[out["jaccard"] >= least]

    return compare
