"""Exact top-k search by aggregation over sorted lists without random access."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions

EXACT = 2.0**53
BOUND_BYTES = 32 << 20
FIRST = 1 / 64  # share of the lists that the first step reads; steps double up to an eighth
LEAST, MOST = -(2**63), 2**63 - 1
FOUND = "row_no long, query_id long, own_row long, vec_id long, score long, entries long"


class Lists:
    """One list for each dimension of a block of vectors: its rows by component, sorted once for all queries."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(vectors.T, self.order, axis=1)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, bar: float = -np.inf) -> tuple[np.ndarray, int]:
        """The rows that can be among the k highest inner products with ``q``, and how many list entries were read to tell.

        A list is read from its top if the query's component is positive, from
        its bottom if it is negative, and not at all if it is zero; heavy lists
        are read in longer steps. Of a row that has been met in some lists the
        score lies between what was seen plus the worst value of each other list
        and what was seen plus the value that list has reached. Rows below the
        k-th best lower bound (or ``bar``, if that is known to be reached
        elsewhere) are dropped as they fail; once the lists' reached values add
        up to less, no unmet row qualifies. Reading stops when few rows are left
        open, or at the lists' end. ``own`` rows are never returned.
        """
        n = self.order.shape[1]
        lists = np.flatnonzero(q)
        if not n or not len(lists):
            return np.setdiff1d(np.arange(n), own), 0
        w = q[lists]
        up = w > 0
        worst = w * np.where(up, self.values[lists, 0], self.values[lists, -1])
        reached = w * np.where(up, self.values[lists, -1], self.values[lists, 0])
        spread = reached - worst
        step = np.maximum(1, np.ceil(n * FIRST * len(lists) * spread / max(spread.sum(), 1e-300))).astype(np.int64)
        depth = np.zeros(len(lists), np.int64)
        seen, met = np.zeros(n), np.zeros((n, len(lists)))
        open_ = np.zeros(n, bool)  # met and not failed
        failed = np.zeros(n, bool)
        failed[own] = True
        entries = 0
        while True:
            stop = np.minimum(depth + step, n)
            length = stop - depth
            ends = [slice(n - z, n - a) if top else slice(a, z) for a, z, top in zip(depth.tolist(), stop.tolist(), up.tolist())]
            rows = np.concatenate([self.order[i, e] for i, e in zip(lists, ends)])
            values = np.concatenate([self.values[i, e] for i, e in zip(lists, ends)])
            entries += len(rows)
            seen += np.bincount(rows, np.repeat(w, length) * values, minlength=n)
            met.reshape(-1)[rows * len(lists) + np.repeat(np.arange(len(lists)), length)] = 1.0
            depth = stop
            more = depth < n
            here = np.minimum(depth, n - 1)
            reached = np.where(more, w * self.values[lists, np.where(up, n - 1 - here, here)], 0.0)
            open_[rows] = True
            open_ &= ~failed
            now = np.flatnonzero(open_)
            # What the lists that a row was met in would have given it at least and at most.
            every = 2 * len(now) > n
            part = met if every else met[now]
            least, most = part @ worst, part @ reached
            if every:
                least, most = least[now], most[now]
            lower, upper = seen[now] + worst.sum() - least, seen[now] + reached.sum() - most
            if len(now) >= k:
                bar = max(bar, float(np.partition(lower, len(lower) - k)[len(lower) - k]))
            out = now[upper < bar]
            failed[out], open_[out] = True, False
            left = len(now) - len(out)
            outside = n - int((open_ | failed).sum())
            if not more.any() or left <= 4 * k and (not outside or reached.sum() < bar):
                return np.flatnonzero(open_), entries
            step = np.minimum(step * 2, max(1, n // 8))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search_block(of: pd.DataFrame, among: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of one block of candidates."""
    parts = [pd.DataFrame(columns=[c.split()[0] for c in FOUND.split(", ")], dtype="int64")]
    if of.empty or among.empty:
        return parts[0]
    width = max(1, of["q"].map(len).max(), among["v"].map(len).max())
    q, x = matrix(of["q"], width), matrix(among["v"], width)
    ids, rows = among["vec_id"].to_numpy(), among["own_row"].to_numpy()
    wide = float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * width >= EXACT
    if wide:  # beyond exact doubles: no bounds, Python's integers
        q, x = q.astype(object), x.astype(object)
    else:
        q, x = q.astype(np.float64), x.astype(np.float64)
        lists = Lists(x)
    for y, name, own_row, bar in zip(q, of["query_id"], of["row_no"], of["bar"]):
        own = np.flatnonzero(rows == own_row)
        near, entries = (np.setdiff1d(np.arange(len(x)), own), x.size) if wide else lists.search(y, own, k, -np.inf if pd.isna(bar) else float(bar))
        score = x[near] @ y
        if wide:
            score = [min(MOST, max(LEAST, int(s))) for s in score]
            best = np.array(sorted(range(len(near)), key=lambda i: (-score[i], ids[near[i]]))[:k], np.int64)
        else:
            best = np.lexsort((ids[near], -score))[:k]
        kept = [int(score[i]) for i in best]
        if len(best):
            parts.append(pd.DataFrame({"row_no": own_row, "query_id": name, "own_row": rows[near][best], "vec_id": ids[near][best], "score": kept, "entries": [entries] + [0] * (len(best) - 1)}))
    return pd.concat(parts)


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, candidate_block: int = 4096, query_block: int = 4096, reads: bool = False) -> DataFrame:
    """The k rows of highest inner product for every query row, exactly, over floor(scale * x) components.

    Candidates are dealt into blocks of bounded size, ordered by their largest
    component, so that the lists of a block tell much about its rows; queries
    are dealt into blocks too. A first round searches one block of candidates
    for each query, the one that promises the highest score; its k-th best score
    is a bar for all others. A pair of query and block meets in the second round
    only if the block's largest and smallest components allow a score at the
    bar. What can't be ruled out so is still of the order of all pairs: on
    vectors without structure all blocks remain. Each pair returns k rows at
    most and the last step keeps the best k.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. With ``reads`` a column entries has, on rank 1, the number of list
    entries that were read for the query.

    Rows with a null id, or whose vector is null or holds a null or non-finite
    component take no part; an empty vector scores 0. Vectors of different
    length are compared as if the shorter one ended in zeros. A query never
    returns its own row, but other rows of its id; a repeated query row is
    answered each time. Components and scores beyond 64 bits are set to the
    limit, where they tie. An empty table gives an empty result; other columns
    are ignored.
    """
    spark = df.sparkSession
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))
    vectors = df.filter(whole & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("own_row"))

    @F.pandas_udf("double")
    def place(v: pd.Series) -> pd.Series:
        """Vectors by the dimension and sign of their largest component, and its size: an order that quantiles cut into blocks."""
        out = np.zeros(len(v))
        for i, x in enumerate(v):
            if len(x):
                size = np.abs(x.astype(float))
                at = int(size.argmax())
                out[i] = 2 * (at + 1) + (x[at] < 0) + 1 - 1 / (1 + size[at])
        return pd.Series(out)

    # Found once and stored: the quantiles, the blocks' sizes and the dealing all ask for it.
    rows = cut(vectors.withColumn("place", place("v")), "topk-vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q"), F.max(F.size("v")).alias("width")).first()
    width = total["width"] or 1
    # The blocks' bounds are broadcast: blocks grow beyond candidate_block where there would be over BOUND_BYTES of them.
    blocks = min(max(1, math.ceil(total["n"] / candidate_block)), max(1, BOUND_BYTES // (16 * width)))
    block_rows, query_blocks = math.ceil(total["n"] / blocks), max(1, math.ceil(total["q"] / query_block))

    cuts = rows.select(F.percentile_approx("place", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    bound = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<double>")
    block = F.size(F.filter(bound, lambda b: b < F.col("place")))
    # Many equal places would make one block too large: what is over the size is dealt by row.
    sizes = {r["c"]: r["n"] for r in rows.groupBy(block.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(v) for c, n in sorted(sizes.items()) for v in (c, max(1, math.ceil(n / (2 * block_rows))))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    dealt = cut(rows.withColumn("c", block).select("vec_id", "v", "is_query", "own_row", (F.col("c") * 65536 + F.pmod(F.xxhash64("own_row"), parts[F.col("c")])).cast("long").alias("c")), "topk-blocks")

    ends = dealt.select("c", F.posexplode(F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v"))))).groupBy("c", "pos").agg(F.max("col").alias("high"), F.min("col").alias("low"))
    bounds = ends.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "high", "low"))), lambda e: F.struct(e["high"].cast("double").alias("high"), e["low"].cast("double").alias("low"))).alias("ends"))
    queries = dealt.filter("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("own_row").alias("row_no"), F.pmod(F.xxhash64("own_row", F.lit("query")), F.lit(query_blocks)).cast("long").alias("b"))
    known = bounds.collect()  # two numbers for each block and dimension
    if not known:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long" + (", entries long" if reads else ""))
    shared = spark.sparkContext.broadcast(([r["c"] for r in known], np.array([[[e["high"], e["low"]] for e in r["ends"]] for r in known])))

    def promise(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks, and the highest score that each one's bounds allow (with a margin for rounding)."""
        names, of = shared.value
        terms = np.maximum(of[:, : len(q), 0] * q, of[:, : len(q), 1] * q)
        return np.array(names), terms.sum(axis=1) + 1e-9 * np.abs(terms).sum(axis=1)

    @F.pandas_udf("long")
    def best_block(q: pd.Series) -> pd.Series:
        return pd.Series([int(names[np.argmax(most)]) for names, most in (promise(np.asarray(v, float)) for v in q)], dtype="int64")

    @F.pandas_udf("array<long>")
    def open_blocks(q: pd.Series, done: pd.Series, bar: pd.Series) -> pd.Series:
        found = ((*promise(np.asarray(v, float)), d, b) for v, d, b in zip(q, done, bar))
        return pd.Series([names[(names != d) & (most >= (-np.inf if pd.isna(b) else b))] for names, most, d, b in found])

    n_parts = partitions(spark)
    candidates = dealt.select("vec_id", "v", "own_row", "c")

    def met(pairs: DataFrame) -> DataFrame:
        """``pairs``: query_id, q, row_no, bar, b, c."""
        sent = candidates.join(pairs.select(F.col("b").alias("to_b"), F.col("c").alias("to_c")).distinct(), F.col("c") == F.col("to_c")).select("to_b", "to_c", "vec_id", "v", "own_row")
        both = pairs.repartition(n_parts, "b", "c").groupBy("b", "c").cogroup(sent.repartition(n_parts, "to_b", "to_c").groupBy("to_b", "to_c"))
        return both.applyInPandas(lambda key, of, among: search_block(of, among, k), FOUND)

    first = cut(queries.select("query_id", "q", "row_no", "b", best_block("q").alias("c"), F.lit(None).cast("double").alias("bar")), "topk-queries")
    one = cut(met(first), "topk-first")
    bars = one.groupBy("row_no").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("reached"))
    rest = first.join(bars, "row_no", "left").select("query_id", "q", "row_no", "b", F.col("reached").alias("bar"), F.explode(open_blocks("q", "c", "reached")).alias("c"))
    found = one.unionByName(met(rest))
    order = F.row_number().over(Window.partitionBy("row_no").orderBy(F.desc("score"), "vec_id", "own_row"))
    ranked = found.withColumn("rank", order).filter(F.col("rank") <= k)
    if not reads:
        return ranked.select("query_id", "rank", "vec_id", "score")
    read = found.groupBy("row_no").agg(F.sum("entries").alias("_entries"))
    return ranked.drop("entries").join(read, "row_no").select("query_id", "rank", "vec_id", "score", F.when(F.col("rank") == 1, F.col("_entries")).alias("entries"))
