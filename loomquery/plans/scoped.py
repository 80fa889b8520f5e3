"""Scopes of the pages: an element is a definition, a link in it a reference to something else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import scopes
from loomquery.plans.registry import query, table
from loomquery.sources.stored import stored

#: Elements that don't stand in one of their own kind.
NAMES = ["article", "body", "footer", "h1", "head", "html", "li", "nav", "title", "ul"]
CHUNKS = ["article", "h1", "title"]
_SCOPES = f"""
    piece AS (SELECT page_id AS key, unnest(string_split(coalesce(html, ''), '<')) AS piece, generate_subscripts(string_split(coalesce(html, ''), '<'), 1) - 1 AS nth FROM pages),
    placed AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY key ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1 AS pos FROM piece),
    mark AS (SELECT key, CAST(pos AS BIGINT) AS pos, lower(regexp_extract(piece, '^/?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, starts_with(piece, '/') AS closing, piece AS body FROM placed WHERE nth > 0),
    nth AS (SELECT *, row_number() OVER (PARTITION BY key, name, closing ORDER BY pos) AS n FROM mark WHERE name IN ({", ".join(f"'{n}'" for n in NAMES)})),
    scope AS (SELECT a.key, a.name, a.n AS nth, a.pos AS start, b.pos AS "end" FROM nth a JOIN nth b ON a.key = b.key AND a.name = b.name AND a.n = b.n WHERE NOT a.closing AND b.closing AND a.pos < b.pos),
    link AS (SELECT key, pos, regexp_extract(body, 'href="([^"]*)"', 1) AS target FROM mark WHERE name = 'a' AND NOT closing),
    inner_ AS (SELECT link.key, link.pos, any_value(target) AS target, arg_min(scope.name, ("end" - start, -start, scope.name)) AS scope, arg_min(start, ("end" - start, -start, scope.name)) AS scope_start
               FROM link LEFT JOIN scope ON scope.key = link.key AND start <= link.pos AND link.pos < "end" GROUP BY link.key, link.pos)"""


def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.rlike("piece", F.lit("^[aA]([^a-zA-Z0-9]|$)")), F.regexp_extract("piece", 'href="([^"]*)"', 1))
    return stored(scopes.marks(table(spark, sf_dir, "pages"), "page_id", "html", {"target": target}), "page-marks")


def links(found: DataFrame) -> DataFrame:
    own = found.filter("name = 'a' and not closing").select("key", "at", "target")
    return scopes.innermost(own, scopes.scopes(found, NAMES)).select("key", "at", "target", F.col("inner.name").alias("scope"), F.col("inner.start").alias("scope_start"))


@query(f"""WITH {_SCOPES} SELECT key AS page_id, pos AS "at", target, scope, scope_start FROM inner_""")
def link_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost element around each link."""
    return links(page_marks(spark, sf_dir)).withColumnRenamed("key", "page_id")


@query(f"WITH {_SCOPES} SELECT scope AS caller, target AS callee, count(*) AS n, count(DISTINCT key) AS pages FROM inner_ GROUP BY scope, target")
def scope_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of element refers to: a reference belongs to the innermost element around it."""
    found = links(page_marks(spark, sf_dir)).groupBy(F.col("scope").alias("caller"), F.col("target").alias("callee"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("pages"))


@query(f"""
    WITH {_SCOPES}
    SELECT key AS page_id, name, min(start) AS start, arg_min("end", start) AS "end", count(*) AS n FROM scope WHERE name IN ('nav', 'li', 'article', 'aside') GROUP BY key, name
""")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each page first defines the asked elements; those that it doesn't define are not listed."""
    ranges = scopes.scopes(page_marks(spark, sf_dir), NAMES)
    wanted = F.explode(F.array(*[F.lit(n) for n in ("nav", "li", "article", "aside")])).alias("name")
    return scopes.definitions(ranges, table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), wanted)).withColumnRenamed("key", "page_id")


@query(f"""
    WITH {_SCOPES},
    c AS (SELECT key, min((start, "end", name)) AS c FROM scope WHERE name IN ({", ".join(f"'{n}'" for n in CHUNKS)}) GROUP BY key)
    SELECT page_id, url, c[3] AS chunk, c[1] AS chunk_start, c[2] AS chunk_end FROM pages LEFT JOIN c ON c.key = page_id WHERE contains(html, 'example.com')
""")
def hit_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have the term, each with the first of its chunks."""
    hits = table(spark, sf_dir, "pages").filter(F.contains("html", F.lit("example.com"))).select(F.col("page_id").alias("key"), "url")
    return scopes.first_chunks(hits, scopes.scopes(page_marks(spark, sf_dir), CHUNKS)).withColumnRenamed("key", "page_id")
