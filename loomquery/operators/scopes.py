"""Nested scopes of texts: which one a position lies in, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.sources.stored import stored


def marks(texts: DataFrame, key: str, text: str, own: dict[str, Column] | None = None) -> DataFrame:
    """key, at (from 0), name, closing and ``own`` columns: each tag of a markup text with its place. Comments and declarations are no tags; null texts have none.

    ``own`` columns are made of ``piece``: the whole tag without its "<", and what follows it up to the next.
    They are made before the tags of a text meet, so that pieces are not shuffled.
    """
    pieces = F.split(F.coalesce(F.col(text), F.lit("")), "<", -1)
    each = texts.select(F.col(key).alias("key"), F.posexplode(pieces).alias("nth", "piece"))
    name = F.lower(F.regexp_extract("piece", r"^/?([a-zA-Z][a-zA-Z0-9]*)", 1))
    own = own or {}
    told = each.select("key", "nth", (F.length("piece") + 1).alias("size"), name.alias("name"), F.startswith("piece", F.lit("/")).alias("closing"), *[c.alias(n) for n, c in own.items()])
    before = Window.partitionBy("key").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = told.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) - 1)
    return placed.filter("nth > 0 and name <> ''").select("key", "at", "name", "closing", *own)


def scopes(found: DataFrame, names: list[str]) -> DataFrame:
    """key, name, nth, start, end of the scopes of ``found`` marks: the n-th opening with the n-th closing of a name, for names that don't nest in themselves."""
    own = found.filter(F.col("name").isin(names))
    nth = F.row_number().over(Window.partitionBy("key", "name", "closing").orderBy("at"))
    numbered = own.select("key", "name", "closing", "at", nth.alias("nth"))
    begun = numbered.filter(~F.col("closing")).select("key", "name", "nth", F.col("at").alias("start"))
    ended = numbered.filter("closing").select("key", "name", "nth", F.col("at").alias("end"))
    return begun.join(ended.hint("merge"), ["key", "name", "nth"]).filter(F.col("start") < F.col("end"))


def pieces_of(start: Column, end: Column, levels: int) -> Column:
    """(level, piece) of the aligned stretches of 2^level positions that make up [start, end): two of each level at most."""

    def level(i: int) -> Column:
        low, high = F.shiftright(start + ((1 << i) - 1), i), F.shiftright(end, i)  # the first whole stretch, and the one behind the last
        ends = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))  # those that no larger stretch has
        return F.transform(ends, lambda p: F.struct(F.lit(i).alias("level"), p.alias("piece")))

    return F.filter(F.concat(*[level(i) for i in range(levels)]), lambda x: x["piece"].isNotNull())


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``points`` (key, at and others) with inner: the shortest of the ``ranges`` (key, start, end and others) that hold the point, as a struct, null if none does.

    A range is cut into aligned stretches of powers of two, about two for each
    power; a point lies in one stretch of each power. So points and ranges meet
    by equality on (key, power, stretch), however long a range is and however
    many there are in one key. Of a stretch only the shortest range is kept, so
    a point meets as many rows at most as its text's length has bits. Of equally short ranges the one that
    begins last counts, then the one first in its other columns.

    Points without place, and ranges without both ends or of no length, hold
    nothing; repeated points are answered each time.
    """
    others = [c for c in ranges.columns if c not in ("key", "start", "end")]
    whole = ranges.filter("key is not null and start is not null and end > start and start >= 0")
    levels = int(whole.agg(F.max("end")).first()[0] or 1).bit_length()
    cut = whole.select("key", F.inline(pieces_of(F.col("start").cast("long"), F.col("end").cast("long"), levels)), "start", "end", *others)
    shortest = F.struct((F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("last"), *others, "start", "end")
    held = cut.groupBy("key", "level", "piece").agg(F.min(shortest).alias("range"))
    numbered = stored(points.withColumn("_n", F.monotonically_increasing_id()), "scope-points")
    at = numbered.filter("key is not null and at is not null").select("_n", "key", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(F.col("at").cast("long"), i).alias("piece")) for i in range(levels)])).alias("p")).select("_n", "key", "p.*")
    # A file's or shuffle's compressed size says little about these rows, and Spark would broadcast by it: both sides are shuffled.
    best = at.join(held.hint("merge"), ["key", "level", "piece"]).groupBy("_n").agg(F.min("range").alias("range"))
    inner = F.when(F.col("range").isNotNull(), F.struct(*[F.col(f"range.{c}").alias(c) for c in ("start", "end", *others)]))
    return numbered.join(best.hint("merge"), "_n", "left").select(*points.columns, inner.alias("inner"))


def definitions(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, name, start, end, n: where a symbol (key, name) is first defined, and how often."""
    asked = symbols.select("key", "name").distinct()
    return ranges.join(asked, ["key", "name"]).groupBy("key", "name").agg(F.min(F.struct("start", "end")).alias("first"), F.count(F.lit(1)).alias("n")).select("key", "name", "first.*", "n")


def first_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (key and others) with the first of their text's ``chunks`` (key, name, start, end): what describes a hit that has no metadata of its own."""
    first = chunks.groupBy("key").agg(F.min(F.struct("start", "end", "name")).alias("c")).select("key", F.col("c.name").alias("chunk"), F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))
    return hits.join(first, "key", "left")
