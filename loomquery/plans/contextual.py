"""Contextual ranking with factors made from the given tables, explanations, reranking and suggestions.

Documents are the hits: vectors and documents share their numbers, a document's
last change is the last event of the user of its number, and what it imports is
what it has of a short list of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomquery.functions import text as fn
from loomquery.operators import explain, patterns, ranking, retrieval, understanding
from loomquery.plans.registry import query, rounded, table
from loomquery.plans.texts import _INTENT_SQL, _confidence_sql, _when_any

IMPORTS, CONTEXT_IMPORTS = ["license", "version", "under", "apache", "terms", "public", "general", "software"], ["license", "version", "apache"]
FUNCTIONS, CONTEXT_FUNCTIONS = ["the", "und", "les", "que", "with", "avec"], ["the", "und"]
ASKED = "license version the und"
EXPECTED = ["strategy", "validation", "factory"]


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STOP = "('the', 'is', 'at', 'which', 'on', 'and', 'a', 'an', 'as', 'by', 'for', 'if', 'in', 'it', 'of', 'or', 'to')"


def _keywords_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9_]+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '^[0-9]') AND x NOT IN {_STOP}))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def _pattern_sql() -> str:
    """doc_id and pattern_match of documents with a pattern."""
    parts = []
    for name in EXPECTED:
        near = explain.RELATED.get(name, []) + [base for base, others in explain.RELATED.items() if name in others]
        parts.append("coalesce(" + ", ".join([f"max(confidence) FILTER (pattern = '{name}')", *[f"max(confidence) FILTER (pattern = '{r}') * 0.7" for r in near], "0"]) + ")")
    return f"""SELECT doc_id, CASE WHEN bool_or(pattern IN ({", ".join(f"'{e}'" for e in EXPECTED)})) THEN least(1, least(1, ({" + ".join(parts)}) / {len(EXPECTED)}) * 1.2) ELSE least(1, ({" + ".join(parts)}) / {len(EXPECTED)}) END AS pattern_match
        FROM (SELECT doc_id, pattern, c AS confidence FROM found WHERE c > 0.1) GROUP BY doc_id"""


_FACTORS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS code, lower(coalesce(text, '')) AS low FROM documents),
    found AS ({_confidence_sql()}),
    pat AS ({_pattern_sql()}),
    vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    near AS (SELECT c.id, list_cosine_similarity(c.e, q.e) AS cosine FROM vec c, vec q WHERE q.id = 1),
    seen AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY user_id),
    hit AS (
        SELECT d.doc_id, d.lang, n_chars, quality, cosine, last, coalesce(pattern_match, 0) AS pattern_match, source,
               list_filter({_list(IMPORTS)}, lambda w: list_contains(regexp_extract_all(low, '[a-z0-9_]+'), w)) AS imports,
               list_filter({_list(FUNCTIONS)}, lambda w: list_contains(regexp_extract_all(low, '[a-z0-9_]+'), w)) AS functions,
               {_keywords_sql("code")} AS words
        FROM documents d JOIN t USING (doc_id) LEFT JOIN labels l USING (doc_id) LEFT JOIN near ON near.id = d.doc_id LEFT JOIN seen ON seen.user_id = d.doc_id LEFT JOIN pat USING (doc_id)
    ),
    o AS (
        SELECT *, CASE WHEN len(imports) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(functions) > 0 THEN 0.3 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END AS w,
               0.3 * len(list_intersect(imports, {_list(CONTEXT_IMPORTS)})) / {len(CONTEXT_IMPORTS)} + 0.3 * len(list_intersect(functions, {_list(CONTEXT_FUNCTIONS)})) / {len(CONTEXT_FUNCTIONS)} + CASE WHEN lang = 'en' THEN 0.2 ELSE 0 END AS v
        FROM hit
    ),
    f AS (
        SELECT doc_id, lang,
            CASE WHEN max(n_chars) OVER () > min(n_chars) OVER () THEN (n_chars - min(n_chars) OVER ()) / (max(n_chars) OVER () - min(n_chars) OVER ()) ELSE 0.5 END AS text_relevance,
            CASE WHEN cosine IS NOT NULL THEN least(1, greatest(0, cosine)) WHEN len(words) > 0 THEN {_jaccard_sql("words", _keywords_sql("'" + ASKED + "'"))} ELSE 0 END AS semantic_similarity,
            CASE WHEN cosine IS NOT NULL THEN 0.8 WHEN len(words) > 0 THEN 0.6 ELSE 0.3 END AS semantic_confidence,
            CASE WHEN w > 0 THEN v / w ELSE 0 END AS context_overlap,
            {_jaccard_sql("imports", _list(CONTEXT_IMPORTS))} AS import_similarity,
            CASE WHEN lang = 'en' THEN ln(1.4) / ln(5) ELSE 0.0 END AS proximity_score,
            CASE WHEN last IS NULL THEN 0.5 WHEN max(last) OVER () > min(last) OVER () THEN (last - min(last) OVER ()) / (max(last) OVER () - min(last) OVER ()) ELSE 0.5 END AS recency_score,
            coalesce(quality, 0.3) AS quality_score, CASE WHEN quality IS NULL THEN 0.3 ELSE 0.8 END AS quality_confidence, pattern_match
        FROM o
    ),
    s AS (
        SELECT *, (0.10 * text_relevance + 0.35 * semantic_similarity * semantic_confidence + 0.10 * context_overlap + 0.05 * import_similarity + 0.15 * proximity_score + 0.05 * recency_score + 0.15 * quality_score * quality_confidence + 0.05 * pattern_match)
            / (0.10 + 0.35 * semantic_confidence + 0.10 + 0.05 + 0.15 + 0.05 + 0.15 * quality_confidence + 0.05) AS score FROM f
    )
"""


def _has(words: Column, of: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in of]), lambda w: F.array_contains(words, w))


def contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, the eight factors (value, confidence) and score for the intent to understand."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source", "text")
    v = table(spark, sf_dir, "embeddings")
    one = v.filter("vec_id = 1").select("embedding").first()
    e = F.col("embedding")
    q = F.array(*[F.lit(float(x)) for x in (one[0] if one else [])]).cast("array<double>")
    cosine = v.select(F.col("vec_id").alias("doc_id"), (retrieval.dot(e, q) / F.sqrt(retrieval.dot(e, e) * retrieval.dot(q, q))).alias("cosine"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last"))
    found = explain.pattern_score(patterns.recognise(docs, "doc_id", "text", names=explain.counted(EXPECTED)), "doc_id", EXPECTED)
    # What is asked of a text's words is told before the joins, so that no words are shuffled.
    all_words = docs.select("doc_id", "lang", "n_chars", "source", fn.tokens(F.coalesce("text", F.lit(""))).alias("all"))
    words = all_words.select("*", fn.keywords_of(F.col("all")).alias("words"))
    hit = words.select("doc_id", "lang", "n_chars", "source", (F.size("words") > 0).alias("worded"), fn.jaccard(F.col("words"), fn.keywords(F.lit(ASKED))).alias("shared"), _has(F.col("all"), IMPORTS).alias("imports"), _has(F.col("all"), FUNCTIONS).alias("functions"))
    for more in (table(spark, sf_dir, "labels").select("doc_id", "quality"), cosine, last, found):
        hit = hit.join(more, "doc_id", "left")
    bounds = docs.agg(F.min("n_chars").cast("double").alias("a"), F.max("n_chars").cast("double").alias("z")).first()
    ages = last.join(docs.select("doc_id"), "doc_id", "left_semi").agg(F.min("last").cast("double").alias("a"), F.max("last").cast("double").alias("z")).first()
    none, no = F.lit(None).cast("double"), F.lit(False)
    english = F.coalesce(F.col("lang") == "en", no)
    context, calls = (F.array(*[F.lit(w) for w in ws]) for ws in (CONTEXT_IMPORTS, CONTEXT_FUNCTIONS))

    def bounded(value: Column, of) -> Column:
        return fn.unit_range(value.cast("double"), F.lit(of["a"] or 0.0), F.lit(of["z"] or 0.0))

    semantic = (
        F.when(F.col("cosine").isNotNull(), ranking.factor(fn.unit_range(F.col("cosine"), F.lit(0.0), F.lit(1.0)), 0.8))
        .when(F.col("worded"), ranking.factor(F.col("shared"), 0.6))
        .otherwise(ranking.factor(F.lit(0.0), 0.3))
    )
    return hit.select(
        "doc_id",
        "lang",
        ranking.factor(bounded(F.col("n_chars"), bounds), 1.0).alias("text_relevance"),
        semantic.alias("semantic_similarity"),
        ranking.factor(ranking.context_overlap(context, F.col("imports"), calls, F.col("functions"), no, english), 1.0).alias("context_overlap"),
        ranking.factor(fn.jaccard(F.col("imports"), context), 1.0).alias("import_similarity"),
        ranking.factor(fn.log_damped(fn.path_proximity(F.lit("here/a"), F.col("source"), no, english)), 1.0).alias("proximity_score"),
        ranking.factor(F.when(F.col("last").isNull(), 0.5).otherwise(bounded(F.col("last"), ages)), 1.0).alias("recency_score"),
        ranking.quality(F.col("quality").cast("double"), none, none, no, no).alias("quality_score"),
        ranking.factor(F.coalesce("pattern_match", F.lit(0.0)), 1.0).alias("pattern_match"),
    ).withColumn("score", ranking.weighted_score(F.lit("understand")))


@query(f"{_FACTORS} SELECT doc_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in ranking.FACTORS) + ", round(score, 6) AS score FROM s")
def rank_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight factors from data, and the score they give."""
    found = contextual(spark, sf_dir).select("doc_id", *[F.col(f)["value"].alias(f) for f in ranking.FACTORS], "score")
    return rounded(found, *ranking.FACTORS, "score")


_PARTS = ", ".join(
    f"{{'contribution': {f} * {w} * {c}, 'factor': '{f}', 'value': {f}, 'weight': CAST({w} AS DOUBLE)}}"
    for f, w, c in zip(ranking.FACTORS, ranking.WEIGHTS["understand"], ["1", "semantic_confidence", "1", "1", "1", "1", "quality_confidence", "1"])
)


@query(f"""
    {_FACTORS},
    x AS (SELECT doc_id, unnest([{_PARTS}]) AS p FROM s)
    SELECT doc_id, p.factor AS factor, round(p.value, 6) AS value, round(p.weight, 6) AS weight, round(p.contribution, 6) AS contribution FROM x WHERE p.contribution > 0.01
""")
def rank_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full explanation of a rank: every factor that contributes."""
    found = contextual(spark, sf_dir).select("doc_id", F.inline(explain.contributions("understand"))).filter("contribution > 0.01")
    return rounded(found.select("doc_id", "factor", "value", F.col("weight").cast("double").alias("weight"), "contribution"), "value", "weight", "contribution")


@query(f"""
    {_FACTORS}
    SELECT doc_id, concat_ws('; ', CASE WHEN score > 0.8 THEN 'High relevance match' WHEN score > 0.5 THEN 'Good relevance match' ELSE 'Partial relevance match' END,
        CASE WHEN lang = 'en' THEN 'Matches requested language' END, CASE WHEN context_overlap > 0.7 THEN 'Similar to current code context' END,
        CASE WHEN import_similarity > 0.5 THEN 'Uses similar imports/dependencies' END, CASE WHEN pattern_match > 0.6 THEN 'Follows similar architectural patterns' END) AS explanation FROM s
""")
def result_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = {f: F.col(f)["value"] for f in ranking.FACTORS}
    said = explain.explained(F.col("score"), F.coalesce(F.col("lang") == "en", F.lit(False)), value["context_overlap"], value["import_similarity"], value["pattern_match"])
    return contextual(spark, sf_dir).select("doc_id", said.alias("explanation"))


@query(f"""
    WITH k AS (SELECT conv_id, turn, {_keywords_sql("coalesce(text, '')")} AS w FROM conversations),
    q AS (SELECT conv_id, w AS asked FROM k WHERE turn = 0),
    o AS (SELECT conv_id, turn, {_jaccard_sql("w", "asked")} AS overlap FROM k JOIN q USING (conv_id) WHERE turn > 0)
    SELECT conv_id, turn, round(CASE WHEN max(overlap) OVER w > min(overlap) OVER w THEN (overlap - min(overlap) OVER w) / (max(overlap) OVER w - min(overlap) OVER w) ELSE 0.5 END, 6) AS ce_score
    FROM o WINDOW w AS (PARTITION BY conv_id)
""")
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's later turns by what they share with its first."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    first = turns.filter("turn = 0").select("conv_id", F.coalesce("text", F.lit("")).alias("asked"))
    return rounded(explain.lexical_rerank(turns.filter("turn > 0").join(first, "conv_id"), F.col("asked"), "text", "conv_id").select("conv_id", "turn", "ce_score"), "ce_score")


#: Code made of a document: its text stands inside marks of a pattern, by the document's number. (before, after)
CODE_FORMS = [
    ("class A:\n", "\n_instance = None"),
    ("_instance ", " getInstance"),
    ("def create_thing(", ") -> Thing:"),
    ("class  OurFactory ", ""),
    ("subscribe ", " notify"),
    ("class Observer ", ""),
    ("@cached\n  def f(): ", ""),
    ("class XDecorator ", ""),
    ("async def run(): ", " await it"),
    ("new Promise ", ""),
    ("", ""),
]
_CODE_LANGUAGES = {"en": "python", "de": "javascript", "fr": "typescript"}
_CASES = " ".join(f"WHEN {i} THEN '{a}' || t || '{b}'" for i, (a, b) in enumerate(CODE_FORMS)).replace("\n", "' || chr(10) || '")
_CODE_SQL = f"""
    SELECT doc_id, CASE doc_id % {len(CODE_FORMS)} {_CASES} END AS code, CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODE_LANGUAGES.items())} END AS language
    FROM (SELECT *, coalesce(text, '') AS t FROM documents)
"""


def code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, code, language: every document as a piece of code."""
    text, form = F.coalesce("text", F.lit("")), F.col("doc_id") % len(CODE_FORMS)
    code = F.lit(None).cast("string")
    for i, (before, after) in enumerate(CODE_FORMS):
        code = F.when(form == i, F.concat(F.lit(before), text, F.lit(after))).otherwise(code)
    languages = F.create_map(*[F.lit(x) for pair in _CODE_LANGUAGES.items() for x in pair])
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), F.try_element_at(languages, "lang").alias("language"))


@query(f"""
    WITH c AS MATERIALIZED ({_CODE_SQL}),
    r AS (
        SELECT doc_id, 'singleton' AS pattern, CASE WHEN regexp_matches(code, 'class[\\s\\S]*?_instance\\s*=\\s*None') THEN 0.8 WHEN contains(code, '_instance') AND contains(code, 'getInstance') THEN 0.6 END AS confidence FROM c
        UNION ALL SELECT doc_id, 'factory', CASE WHEN regexp_matches(code, 'def\\s+create\\w+\\s*\\([\\s\\S]*\\)\\s*->\\s*\\w+\\s*:') THEN 0.7 WHEN regexp_matches(code, 'class\\s+\\w*Factory') THEN 0.8 END FROM c
        UNION ALL SELECT doc_id, 'observer', CASE WHEN contains(code, 'subscribe') AND contains(code, 'notify') THEN 0.7 WHEN regexp_matches(code, 'class\\s+\\w*Observer') THEN 0.8 END FROM c
        UNION ALL SELECT doc_id, 'decorator', CASE WHEN regexp_matches(code, '@\\w+\\s*\\n\\s*def') THEN 0.6 WHEN regexp_matches(code, 'class\\s+\\w*Decorator') THEN 0.8 END FROM c
        UNION ALL SELECT doc_id, 'async', CASE WHEN language = 'python' AND (contains(code, 'async def') OR contains(code, 'await '))
            OR language IN ('javascript', 'typescript') AND (contains(code, 'async ') OR contains(code, 'await ') OR contains(code, 'Promise')) THEN 0.9 END FROM c
    )
    SELECT * FROM r WHERE confidence IS NOT NULL
""")
def structural_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that the structure of code shows; the code is made of the documents, whose texts stand between its marks."""
    return code_rows(spark, sf_dir).select("doc_id", F.explode(explain.structural_patterns(F.col("code"), F.col("language"))).alias("pattern", "confidence"))


def _suggestion_sql() -> str:
    cases = []
    for intent, rules in explain.SUGGESTIONS.items():
        each = ", ".join(f"CASE WHEN {('NOT ' + _when_any('lower(q)', words)) if words else 'TRUE'} THEN '{form.split('{}')[0]}' || q || '{form.split('{}')[1]}' END" for form, words in rules)
        cases.append(f"WHEN '{intent}' THEN list_filter([{each}], lambda x: x IS NOT NULL)")
    return f"CASE intent {' '.join(cases)} END"


@query(f"""
    WITH i AS ({_INTENT_SQL}), t AS (SELECT conv_id, turn, coalesce(text, '') AS q, intent FROM i JOIN conversations USING (conv_id, turn)),
    s AS (SELECT conv_id, turn, {_suggestion_sql()} AS s FROM t)
    SELECT conv_id, turn, unnest(s) AS suggestion, generate_subscripts(s, 1) - 1 AS place FROM s
""")
def query_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"), understanding.classify_intent(F.col("text"))["intent"].alias("intent"))
    return turns.select("conv_id", "turn", F.posexplode(explain.suggestions(F.col("q"), F.col("intent"))).alias("place", "suggestion")).withColumn("place", F.col("place").cast("long"))


def _fits_sql() -> str:
    return "CASE intent " + " ".join(f"WHEN '{i}' THEN {_when_any('lower(v)', marks)}" for i, marks in explain.INTENT_MARKS.items()) + " ELSE FALSE END"


@query(f"""
    WITH i AS ({_INTENT_SQL}), t AS (SELECT conv_id, turn, coalesce(text, '') AS q, intent FROM i JOIN conversations USING (conv_id, turn)),
    s AS (SELECT conv_id, turn, q, intent, unnest(list_distinct(list_concat([q], {_suggestion_sql()}))) AS v FROM t),
    k AS (SELECT *, {_keywords_sql("q")}[1:5] AS terms, len(list_filter(regexp_split_to_array(trim(v, ' '), '\\s+'), lambda w: w <> '')) AS n, length(v) / greatest(length(q), 1) AS ratio FROM s),
    r AS (SELECT conv_id, turn, v AS variant, CAST(CASE WHEN v = q THEN 10 ELSE 0 END + 2 * len(list_filter(terms, lambda w: contains(lower(v), w))) + CASE WHEN n BETWEEN 2 AND 10 THEN 1 ELSE 0 END
          + CASE WHEN {_fits_sql()} THEN 3 ELSE 0 END + CASE WHEN ratio BETWEEN 0.8 AND 1.2 THEN 1 WHEN ratio > 1.5 THEN -1 ELSE 0 END AS BIGINT) AS score FROM k)
    SELECT conv_id, turn, md5(variant) AS variant, score, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, md5(variant)) AS rank FROM r QUALIFY rank <= 3
""")
def ranked_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn and the suggestions for it, the three best wordings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"), understanding.classify_intent(F.col("text"))["intent"].alias("intent"))
    each = turns.select("*", F.slice(fn.keywords(F.col("q")), 1, 5).alias("terms"), F.explode(F.array_distinct(F.concat(F.array("q"), explain.suggestions(F.col("q"), F.col("intent"))))).alias("v"))
    scored = each.select("conv_id", "turn", F.md5("v").alias("variant"), explain.variant_score(F.col("v"), F.col("q"), F.col("intent"), F.col("terms")).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("score"), "variant"))
    return scored.withColumn("rank", place.cast("long")).filter("rank <= 3")


LANGUAGES = ["english", "german", "french", "spanish"]


@query(f"""
    WITH c AS (SELECT doc_id, lang AS asked, CASE WHEN doc_id % 3 = 0 THEN lang || 'x' WHEN doc_id % 3 = 1 THEN CASE lang WHEN 'en' THEN 'Eng' WHEN 'de' THEN 'GERMAN' ELSE 'spa' END ELSE NULL END AS language FROM documents)
    SELECT doc_id, CASE WHEN lower(language) IN ('english', 'german', 'french', 'spanish') THEN lower(language)
                        WHEN substr(lower(language), 1, 3) = 'eng' THEN 'english' WHEN substr(lower(language), 1, 3) = 'fre' THEN 'french'
                        WHEN substr(lower(language), 1, 3) = 'ger' THEN 'german' WHEN substr(lower(language), 1, 3) = 'spa' THEN 'spanish' END AS language,
           CASE WHEN language IS NOT NULL AND NOT substr(lower(language), 1, 3) IN ('eng', 'fre', 'ger', 'spa') THEN 'unknown language' END AS error FROM c
""")
def language_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages asked for in several spellings, as they are known."""
    third = F.col("doc_id") % 3
    asked = F.when(third == 0, F.concat("lang", F.lit("x"))).when(third == 1, F.when(F.col("lang") == "en", "Eng").when(F.col("lang") == "de", "GERMAN").otherwise("spa"))
    return table(spark, sf_dir, "documents").select("doc_id", explain.language_checked(asked, LANGUAGES).alias("x")).select("doc_id", "x.language", "x.error")


@query("""
    SELECT page_id, 'full' AS detail, CASE WHEN page_id % 2 = 0 THEN 'relevance' ELSE 'size' END AS "order", nullif(regexp_replace(url, '[^\\w./-]', '', 'g'), '') AS repository,
           CASE WHEN page_id % 2 = 1 THEN 'order' WHEN contains(regexp_replace(url, '[^\\w./-]', '', 'g'), '..') THEN 'repository' END AS error FROM pages
""")
def parameter_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = explain.parameters_checked(F.lit("full"), F.when(F.col("page_id") % 2 == 0, "relevance").otherwise("size"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", checked.alias("x")).select("page_id", "x.detail", "x.order", "x.repository", "x.error")
