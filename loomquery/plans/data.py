"""Data quality, health, retention and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import quality
from loomquery.plans.registry import query, rounded, table
from loomquery.sources import tables

_FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS total, count({f}) AS present, count(*) FILTER (trim(CAST({f} AS VARCHAR), ' ') = '') AS empty, round(100 * count({f}) / greatest(count(*), 1), 2) AS percent FROM documents"
        for f in _FIELDS
    )
)
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coverage(table(spark, sf_dir, "documents"), _FIELDS)


_LABELLED = "(SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT doc_id, 'quality' AS field FROM {_LABELLED} WHERE quality IS NULL UNION ALL SELECT doc_id, 'toxic' FROM {_LABELLED} WHERE toxic IS NULL")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.missing(docs, "doc_id", ["quality", "toxic"])


@query("SELECT count(*) AS total, count(*) FILTER (len(embedding) = 64) AS valid, count(*) FILTER (len(embedding) <> 64) AS invalid, count(*) FILTER (embedding IS NULL) AS missing FROM embeddings")
def embedding_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.embedding_validity(table(spark, sf_dir, "embeddings"), "embedding", 64)


_HEALTH = """
    SELECT day, runs, success_percent, CASE WHEN success_percent < 70 THEN 'critical' WHEN success_percent < 90 THEN 'warning' ELSE 'healthy' END AS status
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS runs, round(100 * avg(CAST(event_type <> 'error' AS INT)), 2) AS success_percent FROM events GROUP BY day)
"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.health(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", F.col("event_type") != "error")


@query(_HEALTH)
def health_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _health(spark, sf_dir)


@query(f"SELECT CASE max(CASE status WHEN 'critical' THEN 4 WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'error' WHEN 2 THEN 'warning' ELSE 'healthy' END AS status FROM ({_HEALTH})")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.worst_status(_health(spark, sf_dir), "status")


@query("""
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS items FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM d)
    SELECT event_type, round(avg(items), 6) AS mean_items, CASE WHEN avg(items) < 10 THEN 'less often' WHEN avg(items) > 1000 THEN 'more often' ELSE 'keep' END AS advice
    FROM r WHERE n <= 20 GROUP BY event_type
""")
def schedule_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("items"))
    return rounded(quality.schedule_advice(daily, "event_type", [F.desc("day")], "items"), "mean_items")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAYS")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.expired(table(spark, sf_dir, "orders"), "o_orderdate", "1998-01-01 00:00:00", 365).select("o_orderkey")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT coalesce(o_totalprice < 50000, FALSE) GROUP BY o_orderstatus")
def delete_by_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.delete_where(table(spark, sf_dir, "orders"), F.col("o_totalprice") < 50000)
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and an update that names every tenth: a new balance, no new name, and keys nobody has."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 10 = 0").select(F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old, new


_CHANGES = """
    WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer),
    new AS (SELECT CASE WHEN c_custkey % 20 = 0 THEN c_custkey ELSE -c_custkey END AS c_custkey, NULL::VARCHAR AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0)
"""


@query(f"{_CHANGES} SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.replace_rows(*_changes(spark, sf_dir), "c_custkey")


@query(f"{_CHANGES} SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM old o FULL OUTER JOIN new n USING (c_custkey)")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.merge_rows(*_changes(spark, sf_dir), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.delete_keys(table(spark, sf_dir, "customer").select("c_custkey"), keys, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 7 = 0 AND o_custkey IS NOT NULL)")
def delete_by_selected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without those of one kind of orders."""
    keys = table(spark, sf_dir, "orders").filter("o_totalprice > 100000 and o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return tables.delete_keys(table(spark, sf_dir, "customer").select("c_custkey"), keys, "c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01' AND NOT coalesce(o_orderstatus = 'F', FALSE)")
def incremental_high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    mark = datetime.datetime(1997, 6, 1)
    return tables.since(table(spark, sf_dir, "orders"), "o_orderdate", mark, F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query("SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return tables.latest(events, "user_id", "at", "event_type")


@query("SELECT doc_id, upper(lang) AS lang FROM documents WHERE n_chars > 500")
def reindex_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reindex(table(spark, sf_dir, "documents"), lambda d: d.select("doc_id", F.upper("lang").alias("lang")), F.col("n_chars") > 500)


@query("SELECT column_name AS field, 'missing' AS problem FROM (DESCRIBE labels) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE documents)) UNION ALL SELECT column_name, 'unexpected' FROM (DESCRIBE documents) WHERE column_name NOT IN (SELECT column_name FROM (DESCRIBE labels))")
def schema_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of labels, as expected of documents."""

    def names(name: str) -> DataFrame:
        return spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in table(spark, sf_dir, name).columns])).alias("field"))

    return quality.field_differences(names("labels"), names("documents"))
