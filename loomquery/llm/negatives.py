"""Hard negatives by a GNAT-style tree: windows of similarity as annuli of distance, leaves searched exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions

FAN_OUT = 16  # split points of a node
MAX_LEAVES = 4096
SAMPLE_ROWS, SAMPLE_BYTES = 8192, 32 << 20  # the tree's split points are chosen among so many vectors
TREE_BYTES = 32 << 20
CHUNK = 256  # queries whose scores stand in memory at once
EXACT = 2.0**53
LEAST, MOST = -(2**63), 2**63 - 1
SLACK = 1e-6  # of the largest distance: above the rounding errors of all bounds


def matrix(lists: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """Lists as rows, zeros behind the shorter ones."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), max(1, width or int(length.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lists)), length), np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)] = lists.flatten().to_numpy()
    return out


def raised(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with one component more, which gives all of them the length ``norm``.

    The square of the distance to a query (whose own extra component is 0) is
    then |query|^2 + norm^2 - 2 * inner product, so that a window of inner
    products is an annulus around the query.
    """
    x = vectors.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(0.0, square))


@dataclass
class Tree:
    """A node has up to FAN_OUT split points; a vector belongs to the child of the nearest one.

    ``points[node]``: the split points. ``below[node]``: for each child another
    node, or -1 - leaf. ``ranges[node]``: [child, point, 0 or 1]: the least and
    the greatest distance from the point to any vector in the child.
    """

    norm: float
    points: list[np.ndarray]
    below: list[list[int]]
    n_leaves: int
    ranges: list[np.ndarray]

    def plain(self) -> tuple:
        return self.norm, self.points, self.below, self.n_leaves, self.ranges

    def place(self, x: np.ndarray, spans: list[np.ndarray]) -> np.ndarray:
        """The leaf of each (raised) vector; ``spans`` is widened by the distances met on the way."""
        leaf = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))] if self.points else []
        while waiting:
            node, rows = waiting.pop()
            far = distances(x[rows], self.points[node])
            child = far.argmin(axis=1)
            for j, after in enumerate(self.below[node]):
                own = child == j
                if own.any():
                    np.minimum(spans[node][j, :, 0], far[own].min(axis=0), out=spans[node][j, :, 0])
                    np.maximum(spans[node][j, :, 1], far[own].max(axis=0), out=spans[node][j, :, 1])
                    if after < 0:
                        leaf[rows[own]] = -1 - after
                    else:
                        waiting.append((after, rows[own]))
        return leaf

    def empty_spans(self) -> list[np.ndarray]:
        return [np.stack([np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)], axis=2) for p in self.points]

    def open_leaves(self, query: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that may hold a vector in one of the annuli [near, far] around ``query``, and the least distance that each may have.

        From the distance to a point and the range of a child around the same
        point, the triangle inequality gives the least and the greatest distance
        of the child's vectors to the query; over all points of the node these
        are intersected. A child whose range meets no annulus is left out with
        all that is below it.
        """
        q = np.append(query.astype(np.float64), 0.0)
        slack = SLACK * (math.sqrt(float(q @ q)) + self.norm)
        if not self.points:
            return np.zeros(1, np.int64), np.zeros(1)
        leaves, least = [], []
        waiting = [(0, 0.0, np.inf)]
        while waiting:
            node, above_low, above_high = waiting.pop()
            d = distances(q[None, :], self.points[node])[0]
            span = self.ranges[node]
            low = np.maximum(np.maximum(d[None, :] - span[:, :, 1], span[:, :, 0] - d[None, :]).max(axis=1), above_low)
            high = np.minimum((d[None, :] + span[:, :, 1]).min(axis=1), above_high)
            meets = ((low[:, None] <= far[None, :] + slack) & (high[:, None] >= near[None, :] - slack)).any(axis=1)
            for j in np.flatnonzero(meets & np.isfinite(span[:, 0, 0])):
                after = self.below[node][j]
                if after < 0:
                    leaves.append(-1 - after)
                    least.append(low[j])
                else:
                    waiting.append((after, low[j], high[j]))
        return np.array(leaves, np.int64), np.array(least)

    def annuli(self, query: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(near, far): the distances of vectors whose inner product with ``query`` is between low and high."""
        q = query.astype(np.float64)
        most = float(q @ q) + self.norm * self.norm
        return np.sqrt(np.maximum(0.0, most - 2.0 * high)), np.where(low <= LEAST, np.inf, np.sqrt(np.maximum(0.0, most - 2.0 * low)))


def grown(sample: np.ndarray, norm: float, leaves: int, seed: int = 0) -> Tree:
    """A tree of about ``leaves`` leaves whose split points are vectors of the (raised) sample, far apart from each other."""
    rng = np.random.default_rng(seed)
    tree = Tree(norm, [], [], 0, [])

    def split(rows: np.ndarray, wanted: int) -> int:
        """The node's number, or -1 - leaf."""
        chosen: list[int] = []
        if wanted > 1 and len(rows) > 1:
            some = rng.permutation(rows)[: 3 * FAN_OUT]
            chosen = [int(some[0])]
            gap = distances(sample[some], sample[chosen])[:, 0]
            while len(chosen) < min(FAN_OUT, wanted) and gap.max() > 1e-9 * norm:
                chosen.append(int(some[gap.argmax()]))
                gap = np.minimum(gap, distances(sample[some], sample[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            tree.n_leaves += 1
            return -tree.n_leaves
        node = len(tree.points)
        tree.points.append(sample[chosen])
        tree.below.append([])
        child = distances(sample[rows], sample[chosen]).argmin(axis=1)
        for j in range(len(chosen)):
            tree.below[node].append(split(rows[child == j], math.ceil(wanted / len(chosen))))
        return node

    split(np.arange(len(sample)), leaves)
    return tree


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exact; beyond 64 bits they are set to the limit."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), LEAST, MOST).astype(np.int64)


FOUND = "row_no long, w int, vec_id long, own_row long, score long"
_FOUND = pa.schema([("row_no", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("own_row", pa.int64()), ("score", pa.int64())])


def search_leaf(of: pa.Table, among: pa.Table, same: bool, k: int) -> pa.Table:
    """For each window of each query the k best rows of a leaf that lie in it: of the query's label (``same``) or of another one."""
    if not of.num_rows or not among.num_rows:
        return _FOUND.empty_table()
    ids, rows, labels = (among.column(c).to_numpy() for c in ("vec_id", "own_row", "label"))
    order = np.lexsort((rows, ids))  # ties go to the smaller id
    ids, rows, labels = ids[order], rows[order], labels[order]
    x, q = matrix(among.column("v")), matrix(of.column("q"))
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x[order], q))
    out: list[list] = [[], [], [], [], []]
    asked = list(zip(*(of.column(c).to_pylist() for c in ("row_no", "label", "windows"))))
    for low in range(0, len(q), CHUNK):
        for s, (row_no, label, windows) in zip(scores(q[low : low + CHUNK], x), asked[low : low + CHUNK]):
            fits = ((labels == label) if same else (labels != label)) & (rows != row_no)
            for window in windows:
                at = np.flatnonzero(fits & (s >= window["low"]) & (s <= window["high"]))
                if len(at) > k:
                    own = s[at]
                    at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
                at = at[np.argsort(-s[at], kind="stable")[:k]]
                out[0] += [row_no] * len(at)
                out[1] += [window["w"]] * len(at)
                for column, values in zip(out[2:], (ids[at], rows[at], s[at])):
                    column += values.tolist()
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND)], schema=_FOUND)


class Index:
    """All vectors of a table, dealt to the leaves of a tree."""

    def __init__(self, rows: DataFrame, leaf_rows: int = 4096, query_block: int = 4096) -> None:
        """``rows``: vec_id, label, v (array of long), own_row. Every row is indexed; the tree's points come from a sample of at most SAMPLE_ROWS rows."""
        self.spark = rows.sparkSession
        self.query_block = query_block
        norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
        known = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(norm).alias("norm")).first()
        self.n = known["n"]
        width = max(1, known["width"] or 1)
        largest = math.sqrt((known["norm"] or 0.0) * (1 + 1e-9))
        bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
        sample = matrix(rows.select("v").orderBy(F.xxhash64("vec_id", "own_row")).limit(bound).toArrow().column("v"), width)
        leaves = max(1, min(math.ceil(self.n / leaf_rows), MAX_LEAVES, TREE_BYTES // (8 * (width + 1))))
        tree = grown(raised(sample, largest), largest, leaves)
        shared = self.spark.sparkContext.broadcast(tree.plain())
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("own_row", pa.int64()), ("leaf", pa.int64()), ("node", pa.int32()), ("child", pa.int32()), ("point", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The rows with their leaves, and then what the task has met of each range."""
            own = Tree(*shared.value)
            spans = own.empty_spans()
            for batch in batches:
                leaf = own.place(raised(matrix(batch.column("v"), width), own.norm), spans)
                blank = [pa.nulls(len(leaf), f.type) for f in schema][5:]
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(schema.field(c).type) for c in ("vec_id", "label", "v", "own_row")] + [pa.array(leaf), *blank], schema=schema)
            for node, span in enumerate(spans):
                j, i = np.nonzero(np.isfinite(span[:, :, 0]))
                blank = [pa.nulls(len(j), f.type) for f in schema][:5]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(np.full(len(j), node), pa.int32()), pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(span[j, i, 0]), pa.array(span[j, i, 1])], schema=schema)

        ddl = "vec_id long, label long, v array<long>, own_row long, leaf long, node int, child int, point int, low double, high double"
        dealt = cut(rows.select("vec_id", "label", "v", "own_row").mapInArrow(deal, ddl), "gnat-leaves")
        tree.ranges = tree.empty_spans()
        # Two numbers for each pair of points of a node.
        for r in dealt.filter("node is not null").groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.ranges[r["node"]][r["child"], r["point"]] = r["low"], r["high"]
        # A leaf of more than its share (many equal vectors) is dealt to several blocks by row.
        sizes = dealt.filter("node is null").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        parts = {r["leaf"]: max(1, math.ceil(r["n"] / (2 * leaf_rows))) for r in sizes.collect()}
        self.tree = self.spark.sparkContext.broadcast((tree.plain(), parts))
        shared_parts = self.spark.sparkContext.broadcast(parts)

        @F.pandas_udf("long")
        def block(leaf: pd.Series, draw: pd.Series) -> pd.Series:
            return leaf * 2**32 + draw % leaf.map(shared_parts.value)

        self.blocks = cut(dealt.filter("node is null").select("vec_id", "label", "v", "own_row", block("leaf", F.pmod(F.xxhash64("own_row"), F.lit(2**31))).alias("c")), "gnat-blocks")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """row_no, w, vec_id, own_row, score, rank: for each window of each query the k best rows of its label (``same``) or of others.

        ``queries``: row_no, q, label, windows (array of w, low, high: inner
        products, both ends included). A first round searches the leaf that may
        be nearest to each query; where it has k rows for a window, the k-th
        score is the window's new lower end. The second round searches all other
        leaves that the annuli still meet. Queries are dealt into blocks, and a
        task has one block and one leaf, both of bounded size.
        """
        shared = self.tree
        count = queries.count()
        blocked = queries.withColumn("b", F.pmod(F.xxhash64("row_no", F.lit("query")), F.lit(max(1, math.ceil(count / self.query_block)))))
        blocks_of = "array<long>"

        def meeting(q: np.ndarray, windows: list) -> tuple[np.ndarray, np.ndarray]:
            plain, _ = shared.value
            tree = Tree(*plain)
            padded = np.zeros(max(len(q), tree.points[0].shape[1] - 1 if tree.points else len(q)))
            padded[: len(q)] = q
            ends = np.array([(w["low"], w["high"]) for w in windows], np.float64).reshape(-1, 2)
            return tree.open_leaves(padded, *tree.annuli(padded, ends[:, 0], ends[:, 1]))

        def parts_of(leaves: np.ndarray) -> list[int]:
            return [int(leaf) * 2**32 + p for leaf in leaves for p in range(shared.value[1].get(int(leaf), 0))]

        @F.pandas_udf("long")
        def home(q: pd.Series, windows: pd.Series) -> pd.Series:
            out = []
            for v, own in zip(q, windows):
                leaves, least = meeting(np.asarray(v, float), own)
                out.append(int(leaves[least.argmin()]) if len(leaves) else None)
            return pd.Series(out, dtype="Int64")

        @F.pandas_udf(blocks_of)
        def all_parts(leaf: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna(x) else parts_of(np.array([x])) for x in leaf])

        @F.pandas_udf(blocks_of)
        def others(q: pd.Series, windows: pd.Series, done: pd.Series) -> pd.Series:
            out = []
            for v, own, first in zip(q, windows, done):
                leaves, _ = meeting(np.asarray(v, float), own)
                out.append(parts_of(leaves[leaves != (-1 if pd.isna(first) else first)]))
            return pd.Series(out)

        n_parts = partitions(self.spark)

        def met(pairs: DataFrame) -> DataFrame:
            """``pairs``: row_no, q, label, windows, b, c."""
            sent = self.blocks.join(pairs.select("b", "c").distinct().withColumnsRenamed({"b": "to_b", "c": "to_c"}), F.col("c") == F.col("to_c")).select("to_b", "to_c", "vec_id", "label", "v", "own_row")
            both = pairs.repartition(n_parts, "b", "c").groupBy("b", "c").cogroup(sent.repartition(n_parts, "to_b", "to_c").groupBy("to_b", "to_c"))
            return both.applyInArrow(lambda of, among: search_leaf(of, among, same, k), FOUND)

        columns = ["row_no", "q", "label", "windows", "b"]
        begun = cut(blocked.withColumn("leaf", home("q", "windows")).filter("leaf is not null"), "gnat-queries")
        one = cut(met(begun.select(*columns, F.explode(all_parts("leaf")).alias("c"))), "gnat-first")
        place = F.row_number().over(Window.partitionBy("row_no", "w").orderBy(F.desc("score"), "vec_id", "own_row"))
        bars = one.withColumn("rank", place).filter(F.col("rank") == k).groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("bars"))  # a number for each window
        raised_low = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], F.coalesce(F.try_element_at("bars", w["w"]), w["low"])).alias("low"), w["high"].alias("high")))
        rest = begun.join(bars, "row_no", "left").withColumn("windows", F.when(F.col("bars").isNull(), F.col("windows")).otherwise(raised_low))
        rest = rest.select(*columns, F.explode(others("q", "windows", "leaf")).alias("c"))
        return one.unionByName(met(rest)).withColumn("rank", place).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    scale: int = 256,
    low: tuple[int, int] = (1, 2),
    high: tuple[int, int] = (19, 20),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    leaf_rows: int = 4096,
) -> DataFrame:
    """Rows of other labels that are almost as similar to an anchor as its positives are.

    Similarity is the inner product of floor(scale * x) components. An anchor's
    positives are its ``n_positives`` most similar other rows of its label. For
    each of them, the ``n_negatives`` most similar rows of other labels whose
    similarity is between ``low`` and ``high`` (fractions) of the positive's are
    returned: anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score. Ties go to the smaller id. The search is
    exact, whatever the tree.

    ``label`` and ``is_anchor`` are expressions over ``df``. Rows whose id,
    label or vector is null, or whose vector holds a null or non-finite
    component, take no part; vectors of different length are compared as if the
    shorter ended in zeros. A positive of negative similarity has an empty
    window. Repeated rows are rows of their own: each is an anchor, a positive
    or a negative. Components and scores beyond 64 bits are set to the limit. An
    empty table gives an empty result; other columns are ignored.
    """
    x = F.col(vector_col)
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-9.2e18)), F.lit(9.2e18))).cast("long"))
    rows = cut(
        df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(whole, scaled).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
        .filter("vec_id is not null and label is not null and v is not null")
        .withColumn("own_row", F.monotonically_increasing_id()),
        "gnat-rows",
    )
    index = Index(rows, leaf_rows)
    anchors = rows.filter("is_anchor").select(F.col("own_row").alias("row_no"), F.col("vec_id").alias("anchor_id"), F.col("v").alias("q"), "label")
    everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    positives = cut(index.search(anchors.select("row_no", "q", "label", everything.alias("windows")), True, n_positives), "gnat-positives")

    def share(of: tuple[int, int], up: bool) -> Column:
        """score * a / b, rounded up or down, within 64 bits: the quotient's and the remainder's share."""
        a, b = of
        rest = f"pmod(score, {b}L)"
        return F.expr(f"(score - {rest}) div {b}L * {a}L + ({rest} * {a}L + {b - 1 if up else 0}L) div {b}L")

    window = F.struct(F.col("rank").alias("w"), share(low, True).alias("low"), share(high, False).alias("high"))
    windows = positives.groupBy("row_no").agg(F.collect_list(window).alias("windows"))  # n_positives of them
    negatives = index.search(anchors.join(windows, "row_no").select("row_no", "q", "label", "windows"), False, n_negatives)
    known = positives.select("row_no", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("row_no", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(known, ["row_no", "w"]).join(anchors.select("row_no", "anchor_id"), "row_no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
