"""Wordings of the queries that the events stand for, best ones first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.operators import explain, rewriting, understanding
from loomquery.plans.contextual import _keywords_sql, _list
from loomquery.plans.registry import query, table
from loomquery.plans.texts import _BEST, _INTENTS, _when_any

#: What a user asks at each kind of event, by the event's number.
ASKED = ["create {} view", "how to fix the {} error", "what is {}", "database {} of a user", "why does authentication {}", "test {} api", "exception: {} not working", "{} 7"]


def _rows(table_: dict[str, list[str]]) -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, values in table_.items() for v in values) + ")"


def _case(of: str, values: list[str]) -> str:
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END AS " + of


def _words_sql(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_EMPTY, _VERBS, _NOUNS = _words_sql(rewriting.EMPTY_WORDS), _words_sql(list(understanding.VERBS)), _words_sql(list(rewriting.NOUNS))
_FORMS = {of: "(VALUES " + ", ".join(f"('{f}')" for f in forms) + ")" for of, forms in rewriting.FORMS.items()}
_STATED = " ".join(f"UNION SELECT k, q, substr(q, {len(o) + 1}) || ' {kind}' FROM t WHERE starts_with(q, '{o}')" for o, kind in rewriting.STATEMENTS.items())
_FITS = "CASE intent " + " ".join(f"WHEN '{i}' THEN {_when_any('v', marks)}" for i, marks in explain.INTENT_MARKS.items()) + " ELSE FALSE END"
_SQL = f"""
    WITH e AS (SELECT DISTINCT {_case("q", ["replace('" + a + "', '{}', event_type)" for a in ASKED])}, {_case("language", ["'Python'", "'JavaScript'", "NULL"])},
                      {_case("framework", ["'React'", "NULL"])}, event_type FROM events WHERE event_type IS NOT NULL),
    i AS (SELECT concat_ws('|', q, language, framework) AS k, q, lower(language) AS language, lower(framework) AS framework, event_type, {", ".join(f"{s} AS {name}" for name, s in _INTENTS.items())} FROM e),
    t AS (SELECT *, string_split(q, ' ') AS w, CASE WHEN {_BEST} < 2 THEN 'understand' {" ".join(f"WHEN {name} = {_BEST} THEN '{name}'" for name in _INTENTS)} END AS intent FROM i),
    p AS (SELECT k, q, w, unnest(range(1, len(w) + 1)) AS i FROM t),
    c AS (SELECT *, list_filter(w, lambda x: x NOT IN {_EMPTY}) AS content, list_filter(w, lambda x: x IN {_VERBS})[1] AS verb FROM t),
    o AS (SELECT *, list_filter(w[list_position(w, verb) + 1:], lambda x: x NOT IN {_EMPTY})[1:2] AS thing FROM c),
    n AS (SELECT *, coalesce(nullif(regexp_extract(q, '(?:error|exception):\\s*(\\w+)', 1), ''), nullif(regexp_extract(q, '(\\w+)\\s*(?:error|exception)', 1), ''), nullif(regexp_extract(q, '(?:fix|debug|resolve)\\s+(\\w+)', 1), '')) AS wrong FROM o),
    m AS (SELECT k, q, language AS m FROM t UNION SELECT k, q, framework FROM t UNION SELECT k, q, f.col1 FROM t JOIN {_rows(rewriting.LANGUAGE_FORMS)} f ON f.col0 = language
          UNION SELECT k, q, f.col1 FROM t JOIN {_rows(rewriting.FRAMEWORK_FORMS)} f ON f.col0 = framework UNION SELECT k, q, 'handler' FROM t WHERE contains(q, event_type)),
    v(k, q, v) AS (
        SELECT k, q, q FROM t
        UNION SELECT k, q, array_to_string(w[:i - 1] || [s.col1] || w[i + 1:], ' ') FROM p JOIN {_rows(rewriting.word_table())} s ON s.col0 = w[i]
        UNION SELECT k, q, array_to_string(w[:i - 1] || [w[i + 1], w[i]] || w[i + 2:], ' ') FROM p WHERE len(w) BETWEEN 2 AND 5 AND i < len(w) AND w[i] NOT IN {_EMPTY} AND w[i + 1] NOT IN {_EMPTY}
        UNION SELECT k, q, array_to_string(w[:i - 1] || [regexp_replace(w[i], '([^e])e$', '\\1') || 'ing'] || w[i + 1:], ' ') FROM p WHERE w[i] IN {_VERBS}
        {_STATED}
        UNION SELECT k, q, CASE WHEN w[1] IN {_VERBS} THEN 'how to ' ELSE 'what is ' END || q FROM t WHERE (w[1] IN {_VERBS} OR w[1] IN {_NOUNS}) AND NOT regexp_matches(q, '^({"|".join(rewriting.QUESTION_WORDS)})')
        UNION SELECT k, q, replace(f.col0, '{{}}', array_to_string(thing, ' ')) FROM o, {_FORMS["object"]} f WHERE verb IS NOT NULL AND len(thing) > 0
        UNION SELECT k, q, replace(f.col0, '{{}}', array_to_string(content[1:2], ' ')) FROM c, {_FORMS["concept"]} f WHERE len(content) > 0 AND (contains(q, 'what') OR intent = 'understand')
        UNION SELECT k, q, replace(f.col0, '{{}}', wrong) FROM n, {_FORMS["error"]} f WHERE wrong IS NOT NULL AND (intent = 'debug' OR {_when_any("q", ["error", "fix", "debug"])})
        UNION SELECT k, q, unnest([q || ' ' || f.col1, f.col1 || ' ' || q]) FROM t JOIN {_rows(rewriting.INTENT_WORDS)} f ON f.col0 = intent AND NOT contains(q, f.col1)
        UNION SELECT k, q, q || ' ' || m FROM m WHERE m IS NOT NULL AND NOT contains(q, m)
    ),
    d AS (SELECT v.k, v.q, v, t.w, string_split(v, ' ') AS own, intent, {_keywords_sql("v.q")} AS terms, length(v) / length(v.q) AS ratio FROM v JOIN t USING (k)),
    r AS (SELECT k AS request, v AS variant, CAST(CASE WHEN v = q THEN 10 ELSE 0 END + 2 * len(list_filter(terms, lambda x: contains(v, x))) + CASE WHEN len(own) BETWEEN 2 AND 10 THEN 1 ELSE 0 END
              + CASE WHEN {_FITS} THEN 3 ELSE 0 END + CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 1 WHEN ratio > 1.5 THEN -1 ELSE 0 END AS BIGINT) AS score
          FROM d WHERE v = q OR (len(list_intersect(own, w)) / len(list_distinct(w)) >= 0.5 AND len(own) <= 2 * len(w) AND len(list_distinct(own)) = len(own)))
    SELECT request, variant, score, row_number() OVER (PARTITION BY request ORDER BY score DESC, variant) AS rank FROM r QUALIFY rank <= 10
"""


def _turn(values: list[Column]) -> Column:
    return F.get(F.array(*values), (F.col("event_id") % len(values)).cast("int"))


@query(_SQL)
def query_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best wordings of each different request; requests are made distinct before they are reworded."""
    events = table(spark, sf_dir, "events").filter("event_type is not null")
    asked = _turn([F.replace(F.lit(a), F.lit("{}"), F.col("event_type")) for a in ASKED])
    language, framework = _turn([F.lit("Python"), F.lit("JavaScript"), F.lit(None)]), _turn([F.lit("React"), F.lit(None)])
    requests = events.select(asked.alias("asked"), language.alias("language"), framework.alias("framework"), "event_type").distinct()
    known = requests.withColumns({"request": F.concat_ws("|", "asked", "language", "framework"), "intent": understanding.classify_intent(F.col("asked"))["intent"], "imports": F.array(F.concat("event_type", F.lit(".handler")), F.lit("zz.other"))})
    return rewriting.rewrites(known, "request", "asked", "intent", "language", "framework", "imports")
