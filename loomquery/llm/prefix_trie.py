"""The trie of conversations that begin alike, its sums rolled up in bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.llm.common import cut, partitions

STRETCH = 1 << 16  # turns of a conversation that are gone through in one task
CHUNK = 1 << 16  # identifiers that are joined to one string
HOT = 1000  # parents with most children whose rows are broadcast
KEY = ["depth", "x1", "x2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their place in the conversation from 1, one row per conversation and part of the order with its count).

    Turns are put in order by ranges of (conversation, turn, role, text), so a
    long conversation spreads over as many tasks as it needs. A turn's place is
    its row's number in the task less that of the conversation's first row
    there, plus what earlier tasks hold of the conversation.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(
        placed.select(
            "conv",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row_no"),
            F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest"),
            F.length("text").cast("long").alias("chars"),
        ),
        "trie-turns",
    )
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv", "part").agg(F.min("row_no").alias("first_no"), F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return rows, cut(parts, "trie-parts")


def rebuilt(turns: DataFrame, shared_from: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, chars; conv, length): conversations whose first ``shared`` turns come from those of conversation ``shared_from``.

    ``shared`` is between 0 and 5. Of each conversation that others begin with,
    five turns at most are copied to them.
    """
    rows, parts = numbered(turns)
    counts = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    convs = counts.select("conv", "n", shared_from.alias("base"), shared.cast("long").alias("h"))
    bases = counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut(convs.join(bases, "base", "left").select("conv", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    # The few numbers of a conversation reach its turns over its parts: a long one is in many.
    placed = rows.join(parts.join(convs, "conv").drop("n"), ["conv", "part"]).withColumn("i", F.col("before") + F.col("row_no") - F.col("first_no") + 1)
    own = placed.filter(F.col("i") > F.col("h")).select("conv", (F.col("k") + F.col("i") - F.col("h")).alias("depth"), "digest", "chars")
    heads = placed.filter((F.col("i") <= 5) & (F.col("conv") == F.col("base"))).select("base", F.col("i").alias("depth"), "digest", "chars")
    first = heads.join(convs.filter("k > 0").select("conv", "base", "k"), "base").filter(F.col("depth") <= F.col("k")).select("conv", "depth", "digest", "chars")
    return own.unionByName(first), convs.select("conv", "length")


def chains(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv, depth, x1, x2 (of the node), p1, p2 (of its parent), chars, last: every conversation's way through the trie.

    A node is the exclusive or of the hashes of (depth, turn) over its turns, in
    two lanes of 64 bits: running values that stretches of a conversation give
    each by themselves.
    """
    term = [F.xxhash64(F.lit(lane), "depth", "digest").alias(f"t{lane}") for lane in (1, 2)]
    terms = turns.select("conv", "depth", F.floor(F.col("depth") / STRETCH).alias("stretch"), "chars", *term)
    running = Window.partitionBy("conv", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = cut(terms.withColumns({"x1": F.bit_xor("t1").over(running), "x2": F.bit_xor("t2").over(running)}), "trie-terms")
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("conv", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = totals.select("conv", "stretch", F.bit_xor("s1").over(earlier).alias("b1"), F.bit_xor("s2").over(earlier).alias("b2")).filter("b1 is not null")
    joined = local.join(before, ["conv", "stretch"], "left")
    for lane in (1, 2):
        joined = joined.withColumn(f"x{lane}", F.col(f"x{lane}").bitwiseXOR(F.coalesce(f"b{lane}", F.lit(0))))
        joined = joined.withColumn(f"p{lane}", F.col(f"x{lane}").bitwiseXOR(F.col(f"t{lane}")))
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"))
    way = joined.select("conv", "depth", "x1", "x2", "p1", "p2", "chars").unionByName(roots)
    ends = lengths.select("conv", F.col("length").alias("depth"), F.lit(True).alias("last"))
    return cut(way.join(ends, ["conv", "depth"], "left").withColumn("last", F.coalesce("last", F.lit(False))), "trie-chains")


def rollup(values: DataFrame, way: DataFrame, sums: list[str], deepest: int, height: int, scale: int = 1) -> DataFrame:
    """depth, x1, x2, conv and the ``sums`` over every node's subtree.

    ``values`` has conv (the node's smallest member), depth (a multiple of
    ``scale``) and the nodes' own values; ``way`` has conv, depth, x1, x2. Nodes
    are put into bands of ``height`` depths. Each adds its values to its
    ancestors in its band only, which it finds on its member's way: ``height``
    rows at most, added up for each member and depth before they meet the way.
    The roots of all bands form a trie of a height less by that factor; its sums
    are found in the same manner, and each root's completed sum goes to the
    ancestors in the band above. So there are as many rounds as the depth has
    digits to the base ``height``, not as many as there are bands.
    """

    def spread(rows: DataFrame, low: Column, high: Column) -> DataFrame:
        exploded = rows.select("conv", F.explode(F.sequence(low, high, F.lit(scale).cast("long"))).alias("depth"), *sums)
        at = exploded.groupBy("conv", "depth").agg(*[F.sum(s).alias(s) for s in sums])
        found = at.join(way.filter(F.col("depth") % scale == 0).select("conv", *KEY), ["conv", "depth"])
        return found.groupBy(*KEY).agg(F.min("conv").alias("conv"), *[F.sum(s).alias(s) for s in sums])

    band = height * scale
    depth = F.col("depth")
    local = spread(values, depth - depth % band, depth)
    if deepest < band:
        return local
    local = cut(local, "trie-bands")
    complete = rollup(local.filter(depth % band == 0), way, sums, deepest, height, band)
    above = spread(complete.filter(depth > 0), depth - band, depth - scale)
    return cut(local.unionByName(above).groupBy(*KEY).agg(F.min("conv").alias("conv"), *[F.sum(s).alias(s) for s in sums]), "trie-sums")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: SHA-256 of the sorted identifiers in ``conv``, comma-joined.

    Identifiers are sorted by ranges of (node, identifier) and joined to strings
    of CHUNK at most; a node's strings then pass through the hash one after
    another. Of a hot node only these strings meet in one task, one at a time.
    """
    n = partitions(ends.sparkSession)
    order = [*KEY, "conv"]

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunk = batch.groupby(KEY).cumcount() // CHUNK
            own = batch.assign(first=batch["conv"], ids=batch["conv"].astype(str)).groupby([*KEY, chunk], sort=False)
            yield own.agg(first=("first", "min"), ids=("ids", ",".join)).reset_index()[[*KEY, "first", "ids"]]

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in batch.itertuples(index=False):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*KEY, "ends_sha256"])

    chunks = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(joined, "depth long, x1 long, x2 long, first long, ids string")
    return chunks.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids").mapInPandas(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children and parent_conv_id.

    Of parents only the HOT ones with most children are broadcast; the others
    have less than a thousandth of all nodes as children each and are joined.
    """
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    parents = counted.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    by = ["depth", "p1", "p2"]
    hot = cut(parents.orderBy(F.desc("n_children"), *by).limit(HOT), "trie-hot")
    known = counted.join(F.broadcast(hot.drop("n_children")), by, "left")
    rest = parents.join(F.broadcast(hot.select(*by)), by, "left_anti").select(*by, F.col("parent_conv_id").alias("other"))
    return known.join(rest, by, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "other")).drop("other")


def prefix_trie(df: DataFrame, shared_from: Column, shared: Column, height: int = 16, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations, each rebuilt to begin with turns of another one.

    ``shared_from`` and ``shared`` are expressions over a column conv: the first
    ``shared`` turns (0 to 5; fewer if it has fewer, none if it is absent) of
    conversation ``shared_from`` stand in the place of the conversation's own
    first ``shared`` turns. ``shared_from`` of a conversation that others begin
    with is itself.

    Returns one row for each distinct sequence of first turns (role, text), the
    empty one included: conv_id (the smallest conversation that begins so),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes in the subtree, itself included), saved_tokens (over the
    subtree: n_convs - 1 times the code points of the last text), ends_sha256
    (of the sorted, comma-joined identifiers of the conversations that end
    there; of nothing where none does).

    Turns are ordered by turn, null first; of equal turn by role, then text.
    Null roles and texts are empty. Rows without conversation take no part;
    repeated rows are turns of their own. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    empty = F.lit("")
    turns = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text")
    )
    way = chains(*rebuilt(turns, shared_from, shared))
    nodes = way.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = cut(with_parents(cut(nodes, "trie-nodes")), "trie-parents")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = nodes.select(F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = rollup(values, way, ["n_leaves", "saved_tokens"], deepest, height).drop("conv")
    found = nodes.join(sums, KEY).join(end_digests(way.filter("last")), KEY, "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
