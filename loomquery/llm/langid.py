"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.common import cut

ORDERS = (2, 3, 4)
SLOT_BITS = 20
DRAWS = 1 << 30
UNKNOWN = "und"
#: One odd multiplier for each probe (fixed values: fractional bits of the square roots of 2 and 3).
MULTIPLIERS = (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B)
PER_LANGUAGE = 1500
ENOUGH = 100_000  # n-grams of a language's sample, from which on those met once are left out
#: Signs that count as part of words but are numerals: fractions, superscripts, circled and Roman ones.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 20
COUNTED = 1 << 21  # n-grams that a task counts at a time
SHARES = 10_000  # steps in which shares of known n-grams are counted


def letters(text: str | None) -> str:
    """Lower-cased letters, everything else one blank; empty if there is no letter."""
    if not text:
        return ""
    low = text.lower()
    if not low.isascii() and not _NUMERALS.isdisjoint(low):
        low = low.translate({ord(c): " " for c in _NUMERALS.intersection(low)})
    return _NOT_LETTERS.sub(" ", low).strip()


def grams(text: str, starts: int | None = None) -> np.ndarray:
    """Hashes of all character n-grams of a text, or of those that begin at one of its first ``starts`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], codes
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in ORDERS:
            out.append(h[:starts] * np.uint64(8) + np.uint64(n))
        if len(h) < 2:
            break
    return np.concatenate(out)


def padded(text: str) -> str:
    """A text with the blanks before and behind it that its n-grams may hold."""
    return f" {text} "


def slots(h: np.ndarray) -> list[np.ndarray]:
    mixed = h ^ h >> np.uint64(29)
    return [(mixed * np.uint64(m) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in MULTIPLIERS]


@dataclass
class LanguageFilters:
    """``table[w, slot]`` holds a bit for each of up to 64 languages; more languages take more words w."""

    langs: list[str]
    table: np.ndarray

    def __post_init__(self) -> None:
        bits = [(self.table[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.langs))]
        self.false_rate = np.array(bits) ** len(MULTIPLIERS)

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """For each language, how many n-grams of the text its filter holds; and how many there are."""
        count, total = np.zeros(len(self.langs)), 0
        whole = padded(text)
        for at in range(0, len(whole) - 1, _BLOCK):  # a block also sees what its last n-grams end with
            h = grams(whole[at : at + _BLOCK + max(ORDERS) - 1], _BLOCK)
            total += len(h)
            at_slots = slots(h)
            for w in range(len(self.table)):
                mask = self.table[w][at_slots[0]]
                for s in at_slots[1:]:
                    mask = mask & self.table[w][s]
                own = range(64 * w, min(64 * w + 64, len(self.langs)))
                if len(own) <= 8:  # a histogram of masks, whose bits are then added up
                    seen = np.bincount(mask.astype(np.int64), minlength=1 << len(own))
                    count[own] += [seen[np.arange(len(seen)) >> b & 1 == 1].sum() for b in range(len(own))]
                else:
                    count[own] += [(mask >> np.uint64(b) & np.uint64(1)).sum() for b in range(len(own))]
        return count, total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most n-grams after the expected false hits are taken off, and its share."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """As ``predict``, and the share of all n-grams of the text that the language is held to know."""
        clean = letters(text)
        if not clean or not self.langs:
            return UNKNOWN, 0.0, 0.0
        count, total = self.hits(clean)
        real = np.maximum(0.0, (count - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))
        best = int(np.argmax(real))
        return self.langs[best], float(real[best] / real.sum()) if real.sum() > 0 else 0.0, float(real[best] / total)


def draw(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, per_language: int | None) -> tuple[DataFrame, list[str]]:
    """lang, text of about ``per_language`` rows of each language (all, if fewer, or if it is None), by a hash of key and text; and the languages."""
    rows = labelled.select(F.col(key_col).alias("key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    # A uniform draw against each language's share: no window, so the most frequent language is in no single task.
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "lang", "text"), F.lit(DRAWS)))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    langs = [r["lang"] for r in sizes]
    if not langs:
        return rows.select("lang", "text"), []
    limit = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(math.ceil(DRAWS * min(1.0, per_language / r["n"] if per_language else 1.0))))])
    return rows.filter(F.col("draw") < limit[F.col("lang")]).select("lang", "text"), langs


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int | None = PER_LANGUAGE, distinctive: float = 0.25) -> LanguageFilters:
    """Learn the filters from a bounded sample: about ``per_language`` rows of each language (all, if fewer), by a hash of key and text; from all rows, if that is None.

    An n-gram enters the filter of a language if it occurs there at least twice
    for every PER_LANGUAGE rows, so that filters don't fill up as rows grow
    (once, where the language's sample has less than ENOUGH n-grams), and at no
    less than ``distinctive`` times its rate in the language where it
    is most frequent. Null texts and languages are left out; repeated rows of
    one key are drawn together and count as often as they are there; without
    any labelled row the filters know no language. Counting runs on the cluster; what reaches the driver is
    one mask per filter slot, 2^20 for every 64 languages at most.
    """
    sample, langs = draw(labelled, text_col, lang_col, key_col, per_language)
    if not langs:
        return LanguageFilters([], np.zeros((1, 1 << SLOT_BITS), np.uint64))

    def summed(lang: str, found: list[np.ndarray]) -> pd.DataFrame:
        h, n = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": h.view(np.int64), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found, held = [], 0
                for whole in (padded(t) for t in map(letters, texts) if t):
                    for at in range(0, len(whole) - 1, _BLOCK):  # as in hits
                        found.append(grams(whole[at : at + _BLOCK + max(ORDERS) - 1], _BLOCK))
                        held += len(found[-1])
                        if held > COUNTED:
                            yield summed(lang, found)
                            found, held = [], 0
                if found:
                    yield summed(lang, found)

    counts = cut(sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageFilters([], np.zeros((1, 1 << SLOT_BITS), np.uint64))
    size = F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair])[F.col("lang")]
    twice = F.lit(2)
    if per_language is None or per_language > PER_LANGUAGE:
        rows = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
        twice = F.create_map(*[F.lit(x) for lang in langs for x in (lang, max(2, math.ceil(2 * rows[lang] / PER_LANGUAGE)))])[F.col("lang")]
    rate = counts.withColumn("rate", F.col("n") / size).withColumn("least", F.when(size < ENOUGH, 1).otherwise(twice))
    top = F.max("rate").over(Window.partitionBy("gram"))
    index = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])
    kept = rate.withColumn("top", top).filter((F.col("n") >= F.col("least")) & (F.col("rate") >= distinctive * F.col("top"))).select("gram", index[F.col("lang")].alias("i"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in slots(batch["gram"].to_numpy().view(np.uint64)):
                yield pd.DataFrame({"slot": s, "word": batch["i"] // 64, "bit": batch["i"] % 64})

    masks = kept.mapInPandas(place, "slot long, word int, bit int").groupBy("word", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toPandas()
    table = np.zeros(((len(langs) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    table[masks["word"], masks["slot"]] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilters(langs, table)


def identify(df: DataFrame, filters: LanguageFilters, text_col: str = "text", share: bool = False):
    """A column of (lang, score), and on demand the share of known n-grams, for a text column. The filters' size is fixed: 8 MB for every 64 languages.

    Null text and text without a letter (of a Unicode letter category; numerals
    of any kind are none) give ("und", 0); texts of any length are read whole,
    each n-gram once. Ties fall to the language first in the alphabet. Each row
    is judged by itself, so repeated rows get the same answer; an empty table
    gives an empty result; other columns play no part.
    """
    shared = df.sparkSession.sparkContext.broadcast((filters.langs, filters.table))

    names = ["lang", "score", "share"] if share else ["lang", "score"]

    @F.pandas_udf("lang string, score double" + (", share double" if share else ""))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = LanguageFilters(*shared.value)
        for batch in texts:
            yield pd.DataFrame([model.judge(t)[: len(names)] for t in batch], columns=names)

    return predict(F.col(text_col).cast("string"))


def floors(labelled: DataFrame, filters: LanguageFilters, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int | None = PER_LANGUAGE, part: float = 0.5) -> dict[str, float]:
    """For each language the least share of known n-grams that still counts as it.

    This is ``part`` of the median over the labelled sample (all rows, if
    ``per_language`` is None), or its hundredth part from below where that is
    less: of a language's labelled rows at least 99 in 100 stay, and of a sample
    too small to know its own n-grams all.
    """
    sample, _ = draw(labelled, text_col, lang_col, key_col, per_language)
    return floors_of(sample.select("lang", identify(sample, filters, share=True)["share"].alias("share")), part)


def floors_of(told: DataFrame, part: float = 0.5) -> dict[str, float]:
    """The floors from rows that are told already (lang, share). Shares are cut to SHARES steps and counted, so that no task or driver has a row for each text."""
    steps: dict[str, list[tuple[int, int]]] = {}
    for r in told.filter("lang is not null and share is not null").groupBy("lang", F.floor(F.col("share") * SHARES).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect():
        steps.setdefault(r["lang"], []).append((r["step"], r["n"]))
    out = {}
    for lang, counted in steps.items():
        step, upto = np.array([s for s, _ in counted]), np.cumsum([n for _, n in counted])
        total = int(upto[-1])

        def at(place: int) -> float:
            return float(step[np.searchsorted(upto, place, side="right")]) / SHARES

        out[lang] = min(part * (at((total - 1) // 2) + at(total // 2)) / 2, at(math.ceil(0.01 * total) - 1))
    return out
