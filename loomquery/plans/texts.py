"""Text functions, query understanding and patterns over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions import code
from loomquery.functions import text as fn
from loomquery.operators import chunking, patterns, understanding
from loomquery.plans.registry import query, rounded, table


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;| ', ' ', 'g'), ' ') AS text FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.strip_tags(F.col("html")).alias("text"))


@query("""
    SELECT doc_id, coalesce(CASE WHEN length(line) > 120 THEN left(line, 120) || '…' ELSE line END, '') AS headline FROM (
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 0 AND NOT regexp_matches(x, '^(#|//|/\\*|\\*)'))[1] AS line
        FROM documents
    )
""")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.headline(F.col("text")).alias("headline"))


@query("""
    SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 997) || '...' ELSE text END AS content, coalesce(length(text) > 1000, FALSE) AS truncated,
           greatest(1, length(coalesce(text, '')) // 4) AS tokens
    FROM documents
""")
def truncate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", fn.truncated(t, 1000).alias("content"), fn.is_truncated(t, 1000).alias("truncated"), fn.approx_tokens(t).alias("tokens"))


@query("""
    WITH s AS (SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[\\s\\-]+', '_', 'g')) AS snake FROM part),
    p AS (SELECT *, array_to_string(list_transform(string_split(snake, '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), '') AS pascal FROM s)
    SELECT p_partkey, snake, pascal, lower(left(pascal, 1)) || substr(pascal, 2) AS camel, replace(snake, '_', '-') AS kebab, upper(snake) AS upper FROM p
""")
def case_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    styles = {"snake": fn.snake_case(n), "pascal": fn.pascal_case(n), "camel": fn.camel_case(n), "kebab": fn.kebab_case(n), "upper": fn.upper_case(n)}
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in styles.items()])


@query("""
    SELECT style, count(*) AS n FROM (
        SELECT CASE WHEN regexp_full_match(w, '[A-Z][A-Z0-9]*(_[A-Z0-9]+)+') THEN 'upper'
                    WHEN regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)*') THEN 'snake'
                    WHEN regexp_full_match(w, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camel'
                    WHEN regexp_full_match(w, '([A-Z][a-z0-9]*)+') THEN 'pascal' ELSE 'other' END AS style
        FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents)
    ) GROUP BY style
""")
def naming_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("w"))
    return words.groupBy(fn.naming_style(F.col("w")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, 'https?://[\\w\\.-]+', '<ENV_0>', 'g'),
        '(?i)\\b(eastus|westeurope|centralus|uksouth|japaneast|australiaeast|northeurope|westus2)\\b', '<ENV_1>', 'g'),
        '\\b\\d+\\.\\d+\\.\\d+\\b', '<ENV_2>', 'g'), '\\b(AZURE_[A-Z0-9_]+|ACS_[A-Z0-9_]+)\\b', '<ENV_3>', 'g') AS masked FROM pages
""")
def environment_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fn.masked_environment(F.col("html")).alias("masked"))


@query("""
    SELECT page_id,
           CASE WHEN regexp_matches(path, '\\.html$') THEN 'html' WHEN regexp_matches(path, '\\.py$') THEN 'python' ELSE 'text' END AS language,
           CASE WHEN regexp_matches(path, '\\.html$') THEN 'text/html' WHEN regexp_matches(path, '\\.py$') THEN 'text/x-python' ELSE 'application/octet-stream' END AS mime,
           CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS repository
    FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
""")
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", fn.language_of(path).alias("language"), fn.mime_of(path).alias("mime"), fn.repository_of(path).alias("repository"))


@query()
def exact_term_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted phrases, numbers and calls; the look-around in its pattern has no counterpart in the SQL engine."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(fn.exact_terms(F.col("text"))).alias("term"))


@query("""
    SELECT page_id, unnest(list_distinct(list_concat(
        regexp_extract_all(url, '\\b(\\w+)\\s*\\(', 1), regexp_extract_all(url, '(?i)class\\s+(\\w+)', 1), regexp_extract_all(url, '(?i)from\\s+(\\w+)', 1), regexp_extract_all(url, '(?i)import\\s+(\\w+)', 1),
        regexp_extract_all(url, '(\\w+)\\.(\\w+)', 1), regexp_extract_all(url, '(\\w+)\\.(\\w+)', 2),
        list_filter(regexp_split_to_array(url, '\\s+'), lambda x: regexp_full_match(x, '[a-zA-Z_][a-zA-Z0-9_]*') AND length(x) > 2)))) AS entity
    FROM pages
""")
def page_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that a page's address may mean."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(code.entities(F.col("url"))).alias("entity"))


def _when_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _context_sql(text: str) -> str:
    return f"""CASE WHEN {_when_any(text, fn.FAILING)} THEN CASE WHEN {_when_any(text, fn.FAILING_VECTORS)} THEN 'vector_error_handling' ELSE 'error_handling' END
        WHEN {_when_any(text, fn.CODING)} THEN CASE WHEN {_when_any(text, fn.CODING_VECTORS)} THEN 'vector_implementation' ELSE 'implementation' END
        WHEN {_when_any(text, fn.CONFIGURING)} THEN 'configuration' WHEN {_when_any(text, fn.TESTING)} THEN 'testing' ELSE 'general' END"""


@query(f"SELECT doc_id, {_context_sql('lower(coalesce(text, chr(32)))')} AS context_type FROM documents")
def context_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.context_type(F.col("text")).alias("context_type"))


def intent_sql(text: str) -> dict[str, str]:
    """The score of each intent over a lower-cased text."""
    out = {}
    for intent, groups in understanding.KEYWORDS.items():
        parts = [f"CASE WHEN {_when_any(text, [k])} THEN {w} ELSE 0 END" for words, w in zip(groups, understanding.KEYWORD_WEIGHTS) for k in words]
        parts += [f"CASE WHEN regexp_matches({text}, '{p}') THEN 2.5 ELSE 0 END" for p in understanding.PATTERNS[intent]]
        if intent in understanding.OPENINGS:
            words, w = understanding.OPENINGS[intent]
            parts.append(f"CASE WHEN regexp_matches({text}, '^({'|'.join(words)})') THEN {w} ELSE 0 END")
        if intent == "debug":
            parts.append(f"CASE WHEN {_when_any(text, understanding.ERROR_MARKS)} THEN 2.0 ELSE 0 END")
        parts += [f"CASE WHEN {_when_any(text, understanding.TASKS[t])} THEN {w} ELSE 0 END" for t, w in understanding.TASK_BONUS.get(intent, {}).items()]
        out[intent] = "CAST(" + " + ".join(parts) + " AS DOUBLE)"
    return out


_INTENTS = intent_sql("q")
_BEST = f"greatest({', '.join(_INTENTS)})"
_INTENT_SQL = f"""
    SELECT conv_id, turn, CASE WHEN {_BEST} < 2 THEN 'understand' {" ".join(f"WHEN {i} = {_BEST} THEN '{i}'" for i in _INTENTS)} END AS intent, round({_BEST}, 6) AS score
    FROM (SELECT conv_id, turn, {", ".join(f"{s} AS {i}" for i, s in _INTENTS.items())} FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations))
"""


@query(_INTENT_SQL)
def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", understanding.classify_intent(F.col("text")).alias("x")).select("conv_id", "turn", "x.intent", "x.score")
    return rounded(found, "score")


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(trim(text, ' ')), '\\s+'), lambda x: x <> '')"


def _enhancement_sql() -> str:
    """Wordings numbered in the order in which they are made; the first of equal ones counts."""
    verbs = [(verb, other) for verb, others in understanding.VERBS.items() for other in [o for o in others if o != verb][:2]]
    terms = [(intent, term) for intent, pair in understanding.INTENT_TERMS.items() for term in pair[0]]
    full = " ".join(f"WHEN '{short}' THEN '{long}'" for short, long in understanding.ABBREVIATIONS.items())
    numbered = [", ".join(f"({n}, '{a}', '{b}')" for n, (a, b) in enumerate(pairs)) for pairs in (verbs, terms)]
    return f"""
        WITH i AS ({_INTENT_SQL}), t AS (SELECT conv_id, turn, text, intent, {_WORDS_SQL} AS w FROM i JOIN conversations USING (conv_id, turn)),
        v AS (
            SELECT conv_id, turn, 0 AS nth, text AS wording FROM t
            UNION ALL SELECT conv_id, turn, 1, coalesce(array_to_string(list_transform(w, lambda x: CASE x {full} ELSE x END), ' '), '') FROM t
            UNION ALL SELECT conv_id, turn, 2 + n, array_to_string(list_transform(w, lambda x: CASE WHEN x = verb THEN other ELSE x END), ' ') FROM t JOIN (VALUES {numbered[0]}) o(n, verb, other) ON list_contains(w, verb)
            UNION ALL SELECT conv_id, turn, 1000 + n, concat_ws(' ', text, term) FROM t JOIN (VALUES {numbered[1]}) k(n, kind, term) ON kind = intent
        ),
        d AS (SELECT conv_id, turn, wording, min(nth) AS nth FROM v GROUP BY conv_id, turn, wording)
        SELECT conv_id, turn, wording, row_number() OVER (PARTITION BY conv_id, turn ORDER BY nth) - 1 AS place FROM d QUALIFY place < 15
    """


@query(_enhancement_sql())
def query_enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wordings each turn is searched by; their order is part of the result."""
    turns = table(spark, sf_dir, "conversations").withColumn("intent", understanding.classify_intent(F.col("text"))["intent"])
    each = turns.select("conv_id", "turn", F.posexplode(understanding.enhanced(F.col("text"), F.col("intent"))).alias("place", "wording"))
    return each.withColumn("place", F.col("place").cast("long"))


@query(f"""
    WITH i AS ({_INTENT_SQL})
    SELECT conv_id, turn, CASE WHEN n < 10 THEN 'low' WHEN n < 30 THEN 'medium' ELSE 'high' END AS complexity,
           CASE WHEN {_when_any("q", understanding.ADMIN_WORDS)} THEN 'admin' WHEN {_when_any("q", understanding.ERROR_WORDS)} OR intent = 'debug' THEN 'debug'
                WHEN intent = 'implement' THEN 'implementation' ELSE 'search' END AS agent
    FROM i JOIN (SELECT conv_id, turn, lower(coalesce(text, '')) AS q,
                 len(list_filter(regexp_split_to_array(lower(trim(coalesce(text, ''), ' ')), '\\s+'), lambda w: w <> '')) AS n FROM conversations) USING (conv_id, turn)
""")
def query_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    intent = understanding.classify_intent(F.col("text"))["intent"]
    return table(spark, sf_dir, "conversations").withColumn("intent", intent).select("conv_id", "turn", understanding.complexity(F.col("text")).alias("complexity"), understanding.route(F.col("text"), F.col("intent")).alias("agent"))


@query(f"""
    SELECT conv_id, turn, query, CASE WHEN query = '' THEN 'empty' WHEN length(query) > 400 THEN 'too long' WHEN len({_WORDS_SQL.replace("text", "query")}) > 50 THEN 'too many words' END AS error
    FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '{understanding.DANGEROUS}', '', 'g'), ' ') AS query FROM conversations)
""")
def query_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = table(spark, sf_dir, "conversations").select("conv_id", "turn", understanding.validated(F.col("text")).alias("x"))
    return checked.select("conv_id", "turn", "x.query", "x.error")


def _confidence_sql() -> str:
    """One row per pattern; the parts are exact fractions of the keyword and expression counts."""
    selects = []
    for kind, name, words, expressions in patterns.PATTERNS:
        k = " + ".join(f"CAST(contains(low, '{w.lower()}') AS INT)" for w in words)
        e = " + ".join("CAST(regexp_matches(code, '{}') AS INT)".format(x.replace("'", "''")) for x in expressions)
        selects.append(f"SELECT doc_id, '{kind}' AS pattern_type, '{name}' AS pattern, ({k}) / {len(words)} * 0.4 + ({e}) / {len(expressions)} * 0.5 AS c FROM t")
    return " UNION ALL ".join(selects)


@query(f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS code, lower(coalesce(text, '')) AS low FROM documents),
    found AS ({_confidence_sql()})
    SELECT doc_id, pattern_type, pattern, round(c, 6) AS confidence FROM found WHERE c > 0.1
""")
def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(patterns.recognise(table(spark, sf_dir, "documents"), "doc_id", "text"), "confidence")


@query("""
    SELECT doc_id, page - 1 AS page, substr(text, 1 + (page - 1) * 3800, 4000) AS content
    FROM (SELECT doc_id, text, unnest(range(1, CAST(greatest(1, ceil((length(text) - 200) / 3800)) AS BIGINT) + 1)) AS page FROM documents WHERE text IS NOT NULL)
""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(chunking.pages(F.col("text"), 4000, 200)).alias("page", "content")).withColumn("page", F.col("page").cast("long"))


@query("SELECT doc_id, substr(sha256(source || ':' || lang || ':' || doc_id), 1, 16) AS chunk_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    return docs.select("doc_id", chunking.chunk_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("chunk_id"))
