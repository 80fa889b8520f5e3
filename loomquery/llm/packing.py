"""Conflict-constrained best-fit packing of documents into fixed-size bins."""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomquery.llm.common import WORD, ascii_lower, cut

RESULT = "block int, row_no long, bin long, at long, fill long"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, taken in the given order.

    Open bins stand in one list ordered by what is left in them. The search
    begins at the first bin the item fits and goes on to the next larger one
    until a bin has neither the item's cluster nor a full quota of its source.
    Each bin carries both as bitmaps.
    """
    residual: list[tuple[int, int]] = []
    closed: list[int] = []  # bitmap of sources that have reached their quota
    held: list[int] = []  # bitmap of clusters
    quota: list[dict[int, int]] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        source_bit, cluster_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect.bisect_left(residual, (size, -1))
        while at < len(residual) and (closed[residual[at][1]] & source_bit or held[residual[at][1]] & cluster_bit):
            at += 1
        if at < len(residual):
            left, own = residual.pop(at)
        else:
            left, own = capacity, len(closed)
            closed.append(0)
            held.append(0)
            quota.append({})
        held[own] |= cluster_bit
        quota[own][source] = quota[own].get(source, 0) + 1
        if quota[own][source] >= per_source:
            closed[own] |= source_bit
        out.append((own, capacity - left))
        if left > size:
            bisect.insort(residual, (left - size, own))
    return out


def pack(
    df: DataFrame,
    capacity: int = 8192,
    per_source: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    block_rows: int = 4096,
) -> DataFrame:
    """Pack documents into bins of ``capacity`` tokens (words, plus one end each).

    No bin holds two rows of one duplicate cluster (``cluster_col``; by default
    equal texts, A-Z lower-cased) nor more than ``per_source`` rows of one
    source. Rows are dealt by hash into blocks of about ``block_rows``; each is
    packed by best fit, largest first, in one task of bounded size, so blocks
    run in parallel and a bin never spans two. A row longer than a bin fills
    as many whole bins as it needs by itself, and its last piece is packed like
    a row of that size.

    Returns one row per input row: doc_id, size (tokens), full_bins (bins the
    row fills alone), bin_id (where its last piece lies), bin_offset,
    bin_fill (the bin's tokens in use).

    Null and blank texts have size 1. A null source is a source of its own.
    Repeated rows are packed as often as they occur, in different bins. An
    empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cluster = F.xxhash64(ascii_lower(text)) if cluster_col is None else F.xxhash64(F.col(cluster_col))
    rows = cut(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("size"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
            cluster.alias("cluster"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "pack-rows",
    )
    blocks = max(1, math.ceil(rows.count() / block_rows))
    # The row number is part of the deal: rows of a repeated id do not pile up in a block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(blocks)).cast("int")).withColumn("piece", ((F.col("size") - 1) % capacity + 1).cast("long"))

    def pack_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["piece", "doc_id", "row_no"], ascending=[False, True, True])
        sources = pd.factorize(block["source"])[0].tolist()
        many = block["cluster"].duplicated(keep=False)  # only clusters met twice can conflict
        clusters = pd.Series(-1, index=block.index)
        clusters[many] = pd.factorize(block["cluster"][many])[0]
        placed = best_fit(block["piece"].tolist(), sources, clusters.tolist(), capacity, per_source)
        out = pd.DataFrame({"block": key[0], "row_no": block["row_no"].to_numpy(), "bin": [b for b, _ in placed], "at": [a for _, a in placed]})
        out["fill"] = pd.Series(block["piece"].to_numpy()).groupby(out["bin"]).transform("sum")
        return out

    packed = dealt.select("block", "row_no", "doc_id", "piece", "source", "cluster").groupBy("block").applyInPandas(pack_block, RESULT)
    return dealt.join(packed, ["block", "row_no"]).select(
        "doc_id",
        "size",
        F.floor((F.col("size") - F.col("piece")) / capacity).cast("long").alias("full_bins"),
        (F.col("block").cast("long") * 2**32 + F.col("bin")).alias("bin_id"),
        F.col("at").alias("bin_offset"),
        F.col("fill").alias("bin_fill"),
    )
