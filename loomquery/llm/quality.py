"""A quality classifier: ordinal cumulative-link regression over hashed text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import cut

DIMENSIONS = 1 << 22
PREFIXES = (3, 4, 5)
STRETCH = 1 << 20  # entries of the sample that the fit takes at once
KNOWN_WORDS = 300_000
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) % DIMENSIONS


def word_features(word: str) -> set[str]:
    """Of a lower-cased word: itself without outer symbols, its first 3 to 5 letters, and those symbols."""
    bare = _EDGES.sub("", word)
    found = {bare, *(f"{bare[:n]}-" for n in PREFIXES if len(bare) > n)}
    return found if bare == word else found.union(f"symbols:{x}" for x in _EDGES.findall(word))


def shape(raw: list[str]) -> list[str]:
    """Features of the whole text's form: shares of symbols, capitals, repeats and distinct words, in tenths."""
    n = len(raw)
    if not n:
        return ["shape:empty"]
    joined = "".join(raw)
    plain = sum(map(str.isalpha, raw))
    upper = sum(map(str.isupper, raw))
    again = sum(a == b for a, b in zip(raw, raw[1:]))
    return [
        f"shape:plain{10 * plain // n}",
        f"shape:upper{10 * upper // n}",
        f"shape:again{10 * again // n}",
        f"shape:distinct{10 * len(set(raw)) // n}",
        f"shape:length{n.bit_length()}",
        f"shape:word{min(20, len(joined) // n)}",
    ]


def features(text: str | None) -> set[str]:
    """What is known of a text: the features of its lower-cased words, and its shape."""
    raw = text.split() if text else []
    return set(shape(raw)).union(*map(word_features, set(" ".join(raw).lower().split())))


class Features:
    """Distinct buckets of texts: of their words, and of their shape. What a word has is made once and remembered."""

    def __init__(self, used: np.ndarray | None = None) -> None:
        """With ``used`` (ascending) only those buckets, by their place there."""
        self.place = None if used is None else {u: i for i, u in enumerate(used.tolist())}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, features: list[str] | set[str]) -> tuple[int, ...]:
        found = map(bucket, features)
        return tuple(found) if self.place is None else tuple(self.place[b] for b in found if b in self.place)

    def columns(self, text: str | None) -> list[int]:
        raw = text.split() if text else []
        whole = set(" ".join(raw).lower().split())
        form = shape(raw)
        found = set(self.remembered(" " + " ".join(form), lambda: form))  # no word begins with a blank
        for w in whole:
            own = self.known.get(w)
            if own is None:
                own = self.remembered(w, lambda: word_features(w))
            if own:
                found.update(own)
        return sorted(found)

    def remembered(self, key: str, features: Callable[[], list[str] | set[str]]) -> tuple[int, ...]:
        own = self.known.get(key)
        if own is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            own = self.known[key] = self.of(features())
        return own


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(score - thresholds[k]), thresholds ascending, one score for all grades."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """Column k: the probability of a grade above k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def minimised(slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, rate: float = 1.0, memory: int = 12) -> np.ndarray:
    """L-BFGS: descent along the gradient as the last ``memory`` steps bend it, halving a step until it descends enough. ``rate`` is the length of the first one, which nothing is known of."""
    value, gradient = slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0.0) < tolerance:
            break
        direction, shares = -gradient, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ direction))
            direction = direction - shares[-1] * y
        if past:
            s, y, _ = past[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction * (rate / max(1.0, float(np.sqrt(gradient @ gradient))))
        for (s, y, r), share in zip(past, reversed(shares)):
            direction = direction + s * (share - r * (y @ direction))
        falls, length = float(gradient @ direction), 1.0
        if falls >= 0:
            past, direction, falls = [], -gradient, -float(gradient @ gradient)
        while length > 1e-10:
            new_value, new_gradient = slope(x + length * direction)
            if new_value <= value + 1e-4 * length * falls:
                break
            length /= 2
        else:
            break
        s, y = length * direction, new_gradient - gradient
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / float(s @ y))]
        x, value, gradient = x + s, new_value, new_gradient
    return x


def fit_ordinal(column: np.ndarray, length: np.ndarray, grades: np.ndarray, n_grades: int, n_columns: int, steps: int = 150, rate: float = 1.0, tolerance: float = 1e-6, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of maximum likelihood under the cumulative logits, by a second-order method.

    ``column`` holds the columns that are 1, row after row, and ``length`` how
    many each row has; they are gone through in blocks, so that little is needed
    beside them. Thresholds are the first one plus exponentials, so they stay in
    order.
    """
    n, k = len(length), n_grades - 1
    ends = np.concatenate([[0], np.cumsum(length)])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + STRETCH, STRETCH)).clip(0, n))
    blocks = list(zip(cuts, cuts[1:])) if n else []
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    at = np.arange(n)

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood with its penalty, and its gradient."""
        w, first, gaps = x[:n_columns], x[n_columns], np.exp(x[n_columns + 1 :])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.zeros(n)
        for a, b in blocks:
            some = a + np.flatnonzero(length[a:b])
            if len(some):
                score[some] = np.add.reduceat(w[column[ends[a] : ends[b]]], ends[some] - ends[a])
        tail = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -60, 60)))
        bound = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        p = np.maximum(bound[at, grades] - bound[at, grades + 1], 1e-12)
        steep = bound * (1 - bound)
        low, high = steep[at, grades] / p, steep[at, grades + 1] / p  # d log p over each of the two tails' logits
        by_theta = np.bincount(grades[grades > 0] - 1, -low[grades > 0], minlength=k) + np.bincount(grades[grades < k], high[grades < k], minlength=k)
        by_weight = np.zeros(n_columns)
        for a, b in blocks:
            by_weight += np.bincount(column[ends[a] : ends[b]], np.repeat((low - high)[a:b], length[a:b]), minlength=n_columns)
        gradient = np.concatenate([penalty * w - by_weight / n, [-by_theta.sum() / n], [-by_theta[j:].sum() * gaps[j - 1] / n for j in range(1, k)]])
        return float(-np.log(p).mean() + penalty / 2 * (w @ w)), gradient

    x = minimised(slope, np.concatenate([np.zeros(n_columns), start[:1], np.log(np.maximum(0.1, np.diff(start)))]), steps, tolerance, rate)
    return x[:n_columns], x[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(x[n_columns + 1 :]))])


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grade: str,
    n_grades: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = 12_000,
    least: int = 8,
    screen: float = 16.0,
) -> OrdinalModel | None:
    """Fit on at most ``max_rows`` rated rows, lowest id hash first; this sample is the only bound.

    ``grade`` is an SQL expression over ``ratings`` that gives 0 .. n_grades - 1;
    rows where it is null are left out. None if nothing is rated. A bucket gets
    a weight only if it is in ``least`` rows of the sample and the grades of
    these differ from the sample's by a chi-square of ``screen`` and 2 for each
    grade beyond the second; so the many words that say nothing about quality
    cannot add up in long texts, and one that marks a middle grade is kept like
    one that marks the best. Counting and screening run on the cluster; the
    driver gets each row's screened buckets.

    Null texts are empty. A repeated document or rating is a rated row for each
    pair of the two. Empty tables give no model. Other columns play no part.
    """
    rated = ratings.select(F.col(id_col).alias("rated_id"), F.expr(grade).cast("int").alias("rated_grade")).filter("rated_grade is not null and rated_id is not null")
    sample = rated.orderBy(F.xxhash64("rated_id"), "rated_grade").limit(max_rows)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        own = Features()
        return pd.Series([np.array(own.columns(t), np.int32) for t in texts])

    texts = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).cast("string").alias("own_text"))
    joined = texts.join(F.broadcast(sample), F.col("own_id") == F.col("rated_id"))
    rows = cut(joined.select("rated_id", "rated_grade", hashed("own_text").alias("buckets")), "rated-rows")
    total = {r["rated_grade"]: r["n"] for r in rows.groupBy("rated_grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return None
    n_rows = sum(total.values())
    seen = rows.select("rated_grade", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rated_grade") == g).alias(f"n_{g}") for g in sorted(total)])
    off = sum(((F.col(f"n_{g}") - F.col("n") * n / n_rows) ** 2 * (n_rows / n) for g, n in sorted(total.items())), F.lit(0.0)) / F.col("n") * n_rows / F.greatest(n_rows - F.col("n"), F.lit(1))
    chosen = seen.filter((F.col("n") >= least) & (F.col("n") < n_rows)).filter(off >= screen + 2 * max(0, len(total) - 2))
    used = np.sort(np.array([r["bucket"] for r in chosen.select("bucket").collect()], np.int64))

    @F.pandas_udf("array<int>")
    def columns(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            at = np.searchsorted(used, b)
            out.append(at[used[np.minimum(at, len(used) - 1)] == b].astype(np.int32) if len(used) else np.zeros(0, np.int32))
        return pd.Series(out)

    got = rows.select("rated_id", "rated_grade", columns("buckets").alias("columns")).orderBy("rated_id", F.xxhash64("buckets")).limit(max_rows).toArrow()
    lists = got.column("columns").combine_chunks()
    column, length = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    weights, thresholds = fit_ordinal(column, length.astype(np.int64), got.column("rated_grade").to_numpy().astype(np.int64), n_grades, len(used))
    return OrdinalModel({int(b): float(w) for b, w in zip(used, weights)}, thresholds)


def grade_texts(df: DataFrame, model: OrdinalModel | None, text_col: str = "text"):
    """A column (expected_grade, top_probability) for a text column.

    expected_grade is the sum of the tail probabilities, top_probability that of
    the best grade; both are null without a model. Null and empty texts get the score of their shape alone;
    whole texts are read. Each row is graded by itself, so repeated rows get
    the same grades and an empty table an empty result. The model has a weight for each bucket of its bounded
    sample at most, so its size doesn't grow with the corpus.
    """
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("top_probability"))
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.pandas_udf("expected_grade double, top_probability double")
    def grade(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = OrdinalModel(*shared.value)
        used = np.array(sorted(own.weights), np.int64)
        weight = np.array([own.weights[u] for u in used.tolist()])
        features = Features(used)
        for batch in texts:
            score = np.array([weight[features.columns(t)].sum() for t in batch])
            tails = own.tails(score)
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "top_probability": tails[:, -1]})

    return grade(F.col(text_col).cast("string"))
