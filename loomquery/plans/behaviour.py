"""Behaviour analytics over events and conversations. An event's hour in the day stands for the position that was clicked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import feedback
from loomquery.plans.registry import query, rounded, table

#: The time that counts as now.
AS_OF = "2024-01-31 00:00:00"
_SIGNAL = "CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'copy' WHEN 'error' THEN 'refinement' ELSE 'view' END"
_POSITION = "CAST(json_extract(props, '$.k') AS BIGINT) % 10 + 1"


def signal() -> Column:
    e = F.col("event_type")
    return F.when(e == "click", "click").when(e == "purchase", "copy").when(e == "error", "refinement").otherwise("view")


def position() -> Column:
    return F.get_json_object("props", "$.k").cast("long") % 10 + 1


@query(f"""
    SELECT position, count(*) AS shows, CAST(sum(clicked) AS BIGINT) AS clicks, round(sum(clicked) / count(*), 6) AS ctr
    FROM (SELECT {_POSITION} - 1 AS position, CAST(event_type = 'click' AS INT) AS clicked FROM events) WHERE position BETWEEN 0 AND 9 GROUP BY position
""")
def ctr_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.click_through(table(spark, sf_dir, "events"), position() - 1, F.col("event_type") == "click"), "ctr")


@query(f"""
    WITH s AS (SELECT user_id, {_SIGNAL} AS s, {_POSITION} AS p FROM events),
    q AS (SELECT user_id, max(CAST(s = 'click' AS INT)) AS c, max(CAST(s = 'refinement' AS INT)) AS r, max(CAST(s = 'copy' AS INT)) AS k,
                 max(CAST(s = 'click' AND p <= 3 AS INT)) AS e, sum(p) FILTER (s = 'click') AS places, count(*) FILTER (s = 'click') AS clicks FROM s GROUP BY user_id)
    SELECT count(*) AS queries, round(avg(c), 6) AS ctr, round(avg(r), 6) AS refinement_rate, round(avg(k), 6) AS copy_rate, round(avg(e), 6) AS success_at_3,
           round(sum(places) / sum(clicks), 6) AS mean_click_position FROM q
""")
def signal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.signal_metrics(table(spark, sf_dir, "events"), "user_id", signal(), position())
    return rounded(found, "ctr", "refinement_rate", "copy_rate", "success_at_3", "mean_click_position")


_REWARD = f"""
    SELECT user_id, sum(CASE s WHEN 'click' THEN CASE WHEN p <= 3 THEN 0.3 WHEN p <= 5 THEN 0.1 ELSE 0.05 END WHEN 'copy' THEN 0.5 WHEN 'refinement' THEN -0.025 ELSE -0.05 END::DOUBLE) AS reward
    FROM (SELECT user_id, {_SIGNAL} AS s, {_POSITION} AS p FROM events) GROUP BY user_id
"""


@query(f"SELECT user_id, round(reward, 6) AS reward FROM ({_REWARD})")
def query_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rounded(events.groupBy("user_id").agg(F.sum(feedback.reward(signal(), position())).alias("reward")), "reward")


@query("""
    WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS session_start FROM s GROUP BY user_id, session
""")
def sessions_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.sessions(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts")
    return found.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("session_start"))


@query("""
    WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS w FROM conversations),
    b AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t),
    d AS (SELECT conv_id, turn, p, len(list_filter(w, lambda x: NOT list_contains(p, x))) AS added, len(list_filter(p, lambda x: NOT list_contains(w, x))) AS removed FROM b)
    SELECT conv_id, turn, CASE WHEN p IS NULL THEN 0 ELSE added END AS added, CASE WHEN p IS NULL THEN 0 ELSE removed END AS removed,
           CASE WHEN p IS NULL THEN 'first' WHEN added > 0 AND removed = 0 THEN 'expansion' WHEN added = 0 AND removed > 0 THEN 'narrowing'
                WHEN added = 0 AND removed = 0 THEN 'repeat' ELSE 'reformulation' END AS kind
    FROM d
""")
def query_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.refinements(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "added", "removed", "kind")


@query("""
    SELECT topic, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS topic FROM conversations WHERE role = 'user')
    WHERE length(topic) > 3 AND topic NOT IN ('this', 'that', 'with', 'from', 'have', 'will', 'what', 'when', 'where')
    GROUP BY topic ORDER BY n DESC, topic LIMIT 20
""")
def trending_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.trending(table(spark, sf_dir, "conversations").filter("role = 'user'"), "text")


@query("""
    SELECT user_id, event_type, n, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rank FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    ) WHERE rank <= 3
""")
def user_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.top_values(table(spark, sf_dir, "events"), "user_id", "event_type", 3)


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type HAVING count(*) > 0.2 * (SELECT count(*) FROM events)")
def dominant_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feedback.dominant_shares(table(spark, sf_dir, "events"), "event_type", 0.2), "share")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(CAST(event_type = 'error' AS INT)), 6) AS failure_share FROM events GROUP BY day")
def failure_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"))
    return rounded(days.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("failure_share")), "failure_share")


@query(f"""
    WITH r AS ({_REWARD}),
    g AS (SELECT event_type, avg(reward) AS gradient FROM events JOIN r USING (user_id) GROUP BY event_type),
    w AS (SELECT event_type, greatest(0.01, least(0.5, 0.95 * 0.2 + 0.05 * gradient)) AS raw FROM g)
    SELECT event_type, round(raw / sum(raw) OVER (), 6) AS weight FROM w
""")
def weight_update_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that start at 0.2 each, moved by the mean reward of the users behind each kind of event."""
    events = table(spark, sf_dir, "events")
    rewards = events.groupBy("user_id").agg(F.sum(feedback.reward(signal(), position())).alias("reward"))
    gradient = events.select("user_id", "event_type").join(rewards, "user_id").groupBy("event_type").agg(F.avg("reward").alias("gradient")).withColumn("model", F.lit("one"))
    return rounded(feedback.updated_weights(gradient, "model", "event_type", F.lit(0.2), F.col("gradient")).select("event_type", "weight"), "weight")


@query("""
    WITH p AS (SELECT list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> '') AS parts FROM pages),
    e AS (SELECT parts, unnest(range(1, least(3, len(parts) - 1) + 1)) AS i FROM p)
    SELECT array_to_string(parts[1:i], '/') AS prefix, count(*) AS n FROM e GROUP BY prefix ORDER BY n DESC, prefix LIMIT 5
""")
def directory_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.path_prefixes(table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path")), "path")


@query("""
    SELECT event_id, floor(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1e6 + 0.1) / 1e6 AS mean_so_far FROM events
""")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feedback.running_mean(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    # Means over powers of two end in a 5, which engines round differently: cut, with a margin for the last bit.
    return found.select("event_id", (F.floor(F.col("mean_so_far") * 1e6 + 0.1) / 1e6).alias("mean_so_far"))


@query("""
    SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread, round(var_samp(value), 6) AS variance,
           min(value) AS least, max(value) AS most, count(*) - count(DISTINCT round(value, 4)) AS ties, round(arg_max(value, (ts, event_id)), 6) AS latest
    FROM events GROUP BY event_type
""")
def decision_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    found = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("spread"),
        F.var_samp(v).alias("variance"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        (F.count(F.lit(1)) - F.countDistinct(F.round(v, 4))).alias("ties"),
        F.max_by(v, F.struct("ts", "event_id")).alias("latest"),
    )
    return rounded(found, "mean", "spread", "variance", "latest")


@query(f"""
    WITH c AS (SELECT user_id, arg_min({_POSITION}, (ts, event_id)) AS first_click FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT count(*) AS queries, round(avg(1 / first_click), 6) AS mrr, round(avg(1 / (first_click + 1)), 6) AS legacy_mrr FROM c
""")
def mean_reciprocal_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With places from 1; the legacy form adds one more."""
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").withColumn("p", position())
    first = clicks.groupBy("user_id").agg(F.min_by("p", F.struct("ts", "event_id")).alias("first_click"))
    return rounded(first.agg(F.count(F.lit(1)).alias("queries"), F.avg(1 / F.col("first_click")).alias("mrr"), F.avg(1 / (F.col("first_click") + 1)).alias("legacy_mrr")), "mrr", "legacy_mrr")


@query(f"SELECT user_id, count(*) AS n FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range on the timestamp that reaches the scan."""
    now = F.lit(AS_OF).cast("timestamp")
    recent = table(spark, sf_dir, "events").filter((F.col("ts") > now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= now))
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
