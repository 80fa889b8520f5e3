"""Clones among documents and graphs over orders, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomquery.functions.text import masked_environment
from loomquery.operators import clones, graph, near
from loomquery.plans.registry import query, rounded, table


@query("SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY digest HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.exact_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


_MASKED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://[\\w\\.-]+', '<ENV_0>', 'g'),
    '(?i)\\b(eastus|westeurope|centralus|uksouth|japaneast|australiaeast|northeurope|westus2)\\b', '<ENV_1>', 'g'),
    '\\b\\d+\\.\\d+\\.\\d+\\b', '<ENV_2>', 'g'), '\\b(AZURE_[A-Z0-9_]+|ACS_[A-Z0-9_]+)\\b', '<ENV_3>', 'g')"""


@query(f"SELECT sha256({_MASKED}) AS digest, count(*) AS copies, count(DISTINCT text) AS variants, min(doc_id) AS first_key FROM documents GROUP BY digest HAVING count(DISTINCT text) > 1")
def environment_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.environment_forks(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no FROM documents),
    s AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS place FROM (SELECT doc_id, no, trim(regexp_replace(line, '\\s+#.*$', ''), ' ') AS line FROM l) WHERE line <> ''),
    b AS (SELECT doc_id, place, no, array_to_string([line, lead(line, 1) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o, lead(line, 4) OVER o, lead(line, 5) OVER o], chr(10)) AS block,
                 lead(line, 5) OVER o AS last FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
    k AS (SELECT * FROM b WHERE last IS NOT NULL),
    f AS (SELECT block, min(row(doc_id, place, no)) AS f FROM k GROUP BY block HAVING min(doc_id) < max(doc_id)),
    p AS (SELECT k.doc_id AS key, k.place, k.no, f[1] AS source_key, f[3] AS source_line, k.place - f[2] AS shift FROM k JOIN f USING (block) WHERE k.doc_id <> f[1]),
    i AS (SELECT *, place - row_number() OVER (PARTITION BY key, source_key, shift ORDER BY place) AS island FROM p)
    SELECT key, source_key, CAST(min(no) AS BIGINT) AS start_line, CAST(min(source_line) AS BIGINT) AS source_start, count(*) + 5 AS n_lines FROM i GROUP BY key, source_key, shift, island
""")
def block_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = clones.clone_runs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return runs.select("key", "source_key", F.col("start_line").cast("long").alias("start_line"), F.col("source_start").cast("long").alias("source_start"), "n_lines")


_PLACES = """
    c AS (SELECT doc_id, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS representative FROM documents),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM c WHERE doc_id = representative),
    s AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS place FROM (SELECT doc_id, no, trim(regexp_replace(line, '\\s+#.*$', ''), ' ') AS line FROM l) WHERE line <> ''),
    b AS (SELECT doc_id, place, no, array_to_string([line, lead(line, 1) OVER o, lead(line, 2) OVER o, lead(line, 3) OVER o, lead(line, 4) OVER o, lead(line, 5) OVER o], chr(10)) AS block,
                 lead(line, 5) OVER o AS last FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
    k AS (SELECT doc_id, place, no, block FROM b WHERE last IS NOT NULL),
    m AS (SELECT * FROM k WHERE block IN (SELECT block FROM k GROUP BY block HAVING min(doc_id) < max(doc_id)))"""


@query(f"WITH {_PLACES} SELECT doc_id, representative FROM c")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.text_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query(f"""
    WITH {_PLACES}
    SELECT min(doc_id) OVER (PARTITION BY block) AS first_key, first_value(place) OVER (PARTITION BY block ORDER BY doc_id, place) AS first_at, doc_id AS key, place AS at FROM m
""")
def block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a block that two texts hold; the block is named by its first place."""
    own = clones.block_members(table(spark, sf_dir, "documents"), "doc_id", "text")
    first = own.groupBy("block").agg(F.min(F.struct("key", "at")).alias("first"))
    return own.join(first, "block").select(F.col("first.key").alias("first_key"), F.col("first.at").cast("long").alias("first_at"), "key", F.col("at").cast("long").alias("at"))


@query(f"""
    WITH {_PLACES},
    p AS (SELECT a.doc_id AS key, a.place, a.no, z.doc_id AS source_key, z.no AS source_line, a.place - z.place AS shift FROM m a JOIN m z ON a.block = z.block AND z.doc_id < a.doc_id),
    i AS (SELECT *, place - row_number() OVER (PARTITION BY key, source_key, shift ORDER BY place) AS island FROM p)
    SELECT key, source_key, CAST(min(no) AS BIGINT) AS start_line, CAST(min(source_line) AS BIGINT) AS source_start, count(*) + 5 AS n_lines FROM i GROUP BY key, source_key, shift, island
""")
def block_clone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal shared runs of every two distinct texts, whichever came first."""
    runs = clones.clone_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return runs.select("key", "source_key", F.col("start_line").cast("long").alias("start_line"), F.col("source_start").cast("long").alias("source_start"), "n_lines")


def _runs_sql(name: str, key: str, source: str) -> str:
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    after = " || ' ' || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, 5))])
    return f"""
        {name}_w AS (SELECT {key}, unnest(words) AS w, generate_subscripts(words, 1) AS pos, len(words) AS n, array_to_string(words, ' ') AS whole FROM (SELECT {key}, {words} AS words FROM {source})),
        {name} AS (SELECT DISTINCT {key}, run FROM (SELECT {key}, CASE WHEN n < 5 THEN whole ELSE {after} END AS run FROM {name}_w WINDOW o AS (PARTITION BY {key} ORDER BY pos)) WHERE run IS NOT NULL)"""


@query(f"""
    WITH {_runs_sql("t", "doc_id", "documents")}, {_runs_sql("p", "item_id", "benchmark")},
    size AS (SELECT item_id, count(*) AS n FROM p GROUP BY item_id)
    SELECT doc_id, item_id, round(count(*) / n, 6) AS containment FROM t JOIN p USING (run) JOIN size USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) / n >= 0.8
""")
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark passage's five-word runs."""
    found = clones.passages_contained(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", 0.8)
    return rounded(found.select(F.col("text_id").alias("doc_id"), F.col("passage").alias("item_id"), "containment"), "containment")


def _near_sql(source: str) -> str:
    """CTEs up to ``sets``: doc_id, n and representative of every text with a word."""
    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    return f"""
        w AS MATERIALIZED (SELECT doc_id, {words} AS words FROM {source}),
        places AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w WHERE len(words) >= 5),
        lined AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS run FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        t AS MATERIALIZED (SELECT DISTINCT doc_id, run FROM lined WHERE run IS NOT NULL UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4),
        whole AS (SELECT doc_id, count(*) AS n, sha256(string_agg(run, chr(10) ORDER BY run)) AS runs FROM t GROUP BY doc_id),
        sets AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY runs) AS representative FROM whole)"""


def _near_pairs_sql(source: str, least: float) -> str:
    return f"""
        WITH {_near_sql(source)},
        reps AS (SELECT doc_id, n, run FROM t JOIN sets USING (doc_id) WHERE doc_id = representative),
        pairs AS (SELECT a.doc_id AS first_key, b.doc_id AS second_key, count(*) / (a.n + b.n - count(*)) AS jaccard
                  FROM reps a JOIN reps b USING (run) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n)
        SELECT first_key, second_key, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= {least}
    """


_MASKED_DOCS = f"(SELECT doc_id, {_MASKED} AS text FROM documents) AS masked"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", masked_environment(F.coalesce("text", F.lit(""))).alias("masked"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw"))


@query(_near_pairs_sql("documents", 0.8))
def near_duplicates_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different texts that share four fifths of their five-word runs; near_duplicate_members has who stands for whom."""
    return rounded(near.near_pairs(table(spark, sf_dir, "documents"), "doc_id", "text", 0.8), "jaccard")


@query(f"WITH {_near_sql('documents')} SELECT doc_id, representative FROM sets")
def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.members(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query(_near_pairs_sql(_MASKED_DOCS, 0.98))
def environment_forks_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are nearly the same once environment is masked; environment_fork_members has those that are then the same."""
    return rounded(near.near_pairs(_masked(spark, sf_dir), "doc_id", "masked", 0.98), "jaccard")


@query(f"WITH {_near_sql(_MASKED_DOCS)} SELECT doc_id, representative, sha256(coalesce(text, '')) AS raw FROM sets JOIN documents USING (doc_id)")
def environment_fork_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a document's masked text is compared as; texts with one representative and different raw digests are forks."""
    docs = _masked(spark, sf_dir)
    found = near.members(docs, "doc_id", "masked").withColumnRenamed("key", "doc_id")
    return found.join(docs.select("doc_id", "raw"), "doc_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers point to their orders, orders to parts and parts to suppliers."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def end(kind: str, c: str):
        return F.concat(F.lit(kind), F.col(c).cast("string"))

    return (
        orders.select(end("c", "o_custkey").alias("src"), end("o", "o_orderkey").alias("dst"), F.lit("orders").alias("type"))
        .unionByName(lines.select(end("o", "l_orderkey").alias("src"), end("p", "l_partkey").alias("dst"), F.lit("contains").alias("type")))
        .unionByName(lines.select(end("p", "l_partkey").alias("src"), end("s", "l_suppkey").alias("dst"), F.lit("supplied").alias("type")))
    )


_EDGES = """
    e AS (SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
          UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem))"""
_REACHED = f"""
    WITH RECURSIVE {_EDGES},
    r AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
"""


@query(f"{_REACHED} SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def closure_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit("c1").alias("node"))
    return graph.reachable(edges(spark, sf_dir), start, 3).select("node", F.col("depth").cast("long").alias("depth"))


@query(f"{_REACHED} SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r WHERE node LIKE 's%' GROUP BY node")
def shortest_path_to_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.range(1).select(F.lit("c1").alias("node"))
    found = graph.shortest_path_lengths(edges(spark, sf_dir), start, 3).filter(F.startswith("node", F.lit("s")))
    return found.select("node", F.col("depth").cast("long").alias("depth"))


@query(f"""
    WITH {_EDGES},
    n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
    SELECT node, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i) AS BIGINT) AS fan_in FROM n GROUP BY node
""")
def fan_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan(edges(spark, sf_dir))


@query(f"""
    WITH {_EDGES},
    two AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND a.src LIKE 'o%')
    SELECT * FROM two WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e)
""")
def indirect_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the suppliers behind their parts."""
    # Orders, parts and suppliers as numbers: multiples of three, and one or two more.
    order, part, supplier = F.col("l_orderkey").cast("long") * 3, F.col("l_partkey").cast("long") * 3 + 1, F.col("l_suppkey").cast("long") * 3 + 2
    lines = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.struct(order.alias("src"), part.alias("dst")), F.struct(part.alias("src"), supplier.alias("dst")))).alias("e")).select("e.*")
    return graph.indirect(lines).select(F.concat(F.lit("o"), F.expr("src div 3").cast("string")).alias("src"), F.concat(F.lit("s"), F.expr("(dst - 2) div 3").cast("string")).alias("dst"))


_FOLLOWS = """
    e AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, value FROM events) WHERE dst IS NOT NULL AND src <> dst)"""


@query(f"""
    WITH {_FOLLOWS}
    SELECT a.src || '>' || a.dst AS cycle, 2 AS nodes FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
    UNION ALL
    SELECT a.src || '>' || a.dst || '>' || b.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src
    WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst
""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of event that follow each other in a circle of two or three."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    follows = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), after.alias("dst")).filter("dst is not null")
    return graph.cycles(follows, 3)


def _follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), after.alias("dst"))
    return pairs.filter("dst is not null").distinct()


@query(f"""
    WITH RECURSIVE {_FOLLOWS},
    w AS (SELECT src AS first, dst AS last, [src, dst] AS path FROM e WHERE src < dst
          UNION ALL SELECT w.first, e.dst, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.last WHERE e.dst > w.first AND NOT list_contains(w.path, e.dst))
    SELECT array_to_string(path, '>') AS cycle, CAST(len(path) AS INTEGER) AS nodes FROM w JOIN e ON e.src = w.last AND e.dst = w.first
""")
def cycles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple cycles of any length: up to the number of event types."""
    follows = _follows(spark, sf_dir)
    kinds = follows.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    return graph.cycles(follows, max(2, kinds))


@query(f"""
    WITH RECURSIVE {_FOLLOWS},
    nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    r AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
    SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a
""")
def cycle_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's strongly connected component: cycles lie within one, also where they are too many to list."""
    return graph.strong_components(_follows(spark, sf_dir))


@query("""
    SELECT p_partkey AS file, p_type AS module, min(r_name) AS target FROM part, region
    WHERE r_name IN (string_split(p_type, ' ')[1], string_split(p_type, ' ')[-1]) GROUP BY ALL
""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched by their first or last part, as an equality join on both."""
    imports = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), F.col("p_type").alias("module0"), F.replace("p_type", F.lit(" "), F.lit(".")).alias("module"))
    files = table(spark, sf_dir, "region").select(F.col("r_name").alias("path"), F.col("r_name").alias("stem"))
    return graph.resolve_imports(imports.select("file", "module"), files).select("file", F.replace("module", F.lit("."), F.lit(" ")).alias("module"), "target")


@query(f"""
    WITH {_EDGES},
    q AS (SELECT DISTINCT 'c' || o_custkey AS src, 's' || (o_custkey % 10 + 1) AS dst FROM orders WHERE o_custkey % 100 = 0)
    SELECT q.src, q.dst, array_to_string(min([q.src, e1.dst, e2.dst, q.dst]), '>') AS path, 3 AS steps
    FROM q JOIN e e1 ON e1.src = q.src JOIN e e2 ON e2.src = e1.dst JOIN e e3 ON e3.src = e2.dst AND e3.dst = q.dst GROUP BY q.src, q.dst
""")
def supply_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every hundredth customer is connected to a supplier: one shortest path each, node by node."""
    customer = F.col("o_custkey")
    pairs = table(spark, sf_dir, "orders").filter(customer % 100 == 0).select(F.concat(F.lit("c"), customer.cast("string")).alias("src"), F.concat(F.lit("s"), (customer % 10 + 1).cast("string")).alias("dst"))
    return graph.call_chains(edges(spark, sf_dir), pairs).select("src", "dst", F.concat_ws(">", "path").alias("path"), "steps")
