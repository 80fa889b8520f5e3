"""Facts of names, indexes and rankings, one small query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import paths
from loomquery.operators import patterns, quality, ranking
from loomquery.plans.registry import query, rounded, table

_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?].*$', '')"
_ENDINGS = [*paths.ENDINGS, ".PY", ".txt", ""]


@query(f"""
    WITH p AS (SELECT page_id, {_PATH} AS path, regexp_replace({_PATH}, '/+$', '') AS whole FROM pages),
    n AS (SELECT *, string_split(whole, '/')[-1] AS name, regexp_extract(whole, '^(.*?)/+[^/]*$', 1) AS up FROM p),
    q AS (SELECT *, CASE WHEN NOT contains(whole, '/') THEN '.' WHEN up = '' THEN '/' ELSE up END AS parent, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM n)
    SELECT page_id, parent, name, suffix, left(name, length(name) - length(suffix)) AS stem, CASE parent WHEN '.' THEN '' WHEN '/' THEN '/' ELSE parent || '/' END || 'test_' || name AS test_path FROM q
""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, name, ending and stem of the pages' addresses, and where their tests would be."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.parent(path).alias("parent"), paths.name(path).alias("name"), paths.suffix(path).alias("suffix"), paths.stem(path).alias("stem"), paths.test_path(path).alias("test_path"))


@query(f"""
    WITH f AS (SELECT source, 'lib/f' || doc_id || [{", ".join(f"'{e}'" for e in _ENDINGS)}][doc_id % {len(_ENDINGS)} + 1] AS path FROM documents),
    l AS (SELECT source, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.ENDINGS.items())} ELSE 'unknown' END AS language FROM f)
    SELECT source, language, count(*) AS n FROM l GROUP BY ALL
""")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of files that the documents are taken for, by their endings."""
    ending = F.get(F.array(*[F.lit(e) for e in _ENDINGS]), (F.col("doc_id") % len(_ENDINGS)).cast("int"))
    path = F.concat(F.lit("lib/f"), F.col("doc_id").cast("string"), ending)
    return table(spark, sf_dir, "documents").groupBy("source", paths.detected_language(path).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE 'search:' || source || ':' || lang GLOB 'search:*[1-3]:?[!e]' GROUP BY ALL")
def keys_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys made of source and language that a file pattern matches."""
    key = F.concat(F.lit("search:"), "source", F.lit(":"), "lang")
    return table(spark, sf_dir, "documents").filter(paths.glob_matches(key, "search:*[1-3]:?[!e]")).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'given' END AS known, ['def run_' || doc_id || '(x)', 'async  def go', 'class Shape', 'nothing', ''][doc_id % 5 + 1] AS signature,
                      'x = 1; function make' || doc_id % 3 || ' (a) ' || coalesce(text, '') AS code FROM documents)
    SELECT doc_id, coalesce(nullif(known, ''), nullif(regexp_extract(signature, '(?:def|async\\s+def|function|class)\\s+(\\w+)', 1), ''), nullif(regexp_extract(code, '(?:def|async\\s+def|function)\\s+(\\w+)\\s*\\(', 1), '')) AS function FROM s
""")
def function_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of functions from what is known of a hit: name, signature, code."""
    n = F.col("doc_id")
    forms = [F.concat(F.lit("def run_"), n.cast("string"), F.lit("(x)")), F.lit("async  def go"), F.lit("class Shape"), F.lit("nothing"), F.lit("")]
    code = F.concat(F.lit("x = 1; function make"), (n % 3).cast("string"), F.lit(" (a) "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", paths.function_name(F.when(n % 7 == 0, "given"), F.get(F.array(*forms), (n % 5).cast("int")), code).alias("function"))


@query("""
    SELECT page_id, coalesce(CASE WHEN page_id % 3 > 0 THEN list_filter(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' '), lambda x: x <> '' AND page_id % 2 = 0)[1] END, 'page ' || page_id) AS highlight FROM pages
""")
def first_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first highlight of each page, from its title or else from its number."""
    n = F.col("page_id")
    words = F.filter(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " "), lambda x: (x != "") & (n % 2 == 0))
    return table(spark, sf_dir, "pages").select("page_id", paths.first_highlight(F.when(n % 3 > 0, words), F.array(F.concat(F.lit("page "), n.cast("string")))).alias("highlight"))


def _legacy_sql() -> str:
    selects = []
    for kind, name, words, expressions in patterns.PATTERNS:
        k = " + ".join("CAST(contains(low, '{}') AS INT)".format(w) for w in words)
        e = " + ".join("CAST(regexp_matches(low, '(?i){}') AS INT)".format(x.replace("'", "''")) for x in expressions)
        c = " + ".join("CAST(contains(other, '{}') AS INT)".format(w) for w in words)
        selects.append(f"SELECT conv_id, turn, '{kind}' AS pattern_type, '{name}' AS pattern, least(1.0, ({k}) / {len(words)} * 0.6 + ({e}) / {len(expressions)} * 0.4 + ({c}) / {len(words)} * 0.2) AS c FROM t")
    return " UNION ALL ".join(selects)


_KEYWORDS = "[" + ", ".join("'" + " ".join(words) + "'" for _, _, words, _ in patterns.PATTERNS) + "]"


@query(f"""
    WITH t AS (SELECT conv_id, turn, lower({_KEYWORDS}[conv_id % {len(patterns.PATTERNS)} + 1] || ' ' || coalesce(text, '')) AS low, lower({_KEYWORDS}[turn % {len(patterns.PATTERNS)} + 1]) AS other FROM conversations),
    found AS ({_legacy_sql()})
    SELECT conv_id, turn, pattern_type, pattern, round(c, 6) AS confidence FROM found WHERE c > 0.3
""")
def query_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that a request's words speak for; each turn gets the words of one pattern, its context those of another."""
    words = F.array(*[F.lit(" ".join(w)) for _, _, w, _ in patterns.PATTERNS])
    text = F.concat(F.get(words, (F.col("conv_id") % len(patterns.PATTERNS)).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.inline(patterns.query_confidences(text, F.get(words, (F.col("turn") % len(patterns.PATTERNS)).cast("int")))))
    return rounded(found, "confidence")


@query("""
    WITH p AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS gain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
    i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, place) AS ideal FROM p),
    d AS (SELECT user_id, sum(CASE WHEN place <= 10 THEN (pow(2, gain) - 1) / log2(place + 1) END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (pow(2, gain) - 1) / log2(ideal + 1) END) AS best FROM i GROUP BY user_id)
    SELECT user_id, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg FROM d
""")
def ndcg_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time as a ranking, judged by what each led to."""
    gain = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    rows = table(spark, sf_dir, "events").withColumn("gain", gain)
    return rounded(ranking.ndcg(rows, "user_id", ["ts", "event_id"], "gain", 10), "ndcg")


@query("SELECT status, count(*) AS n FROM (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status FROM events GROUP BY user_id) GROUP BY status")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many users are in each state: the kind of their last event."""
    return quality.status_rollup(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
