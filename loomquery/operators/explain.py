"""Pattern scores, explanations, lexical reranking, and suggestions for queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions.text import has_any, jaccard, keywords
from loomquery.operators.analytics import clean_minmax
from loomquery.operators.ranking import FACTORS, WEIGHTS

# Patterns that count for one another at seven tenths.
RELATED = {
    "factory": ["builder", "abstract_factory", "prototype"],
    "observer": ["pub_sub", "event_emitter", "mediator"],
    "decorator": ["wrapper", "proxy", "adapter"],
    "strategy": ["state", "template", "visitor"],
    "repository": ["dao", "unit_of_work", "data_mapper"],
}
RELATED_SHARE, PRESENT_BOOST, NEUTRAL = 0.7, 1.2, 0.5


def counted(expected: list[str]) -> list[str]:
    """The patterns that ``pattern_score`` looks at: the expected ones and those related to them."""
    return sorted({*expected, *(r for name in expected for r in RELATED.get(name, [])), *(base for base, others in RELATED.items() if set(others) & set(expected))})


def pattern_score(found: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """key, pattern_match: how well the patterns found (key, pattern, confidence) match the expected ones.

    An expected pattern counts with its confidence, or with seven tenths of a
    related one's; a hit that has one of the expected patterns itself gets a
    fifth more. Keys without any pattern are not listed: they score 0, or 0.5
    where nothing is expected.
    """
    if not expected:
        return found.select(key).distinct().withColumn("pattern_match", F.lit(NEUTRAL))
    known = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pattern", "confidence"))).alias("_p"))  # a row for each pattern of the registry at most
    total = F.lit(0.0)
    for name in expected:
        near = RELATED.get(name, []) + [base for base, others in RELATED.items() if name in others]
        total = total + F.coalesce(F.try_element_at("_p", F.lit(name)), *[F.try_element_at("_p", F.lit(r)) * RELATED_SHARE for r in near], F.lit(0.0))
    score = F.least(F.lit(1.0), total / len(expected))
    there = F.arrays_overlap(F.map_keys("_p"), F.array(*[F.lit(e) for e in expected]))
    return known.select(key, F.when(there, F.least(F.lit(1.0), score * PRESENT_BOOST)).otherwise(score).alias("pattern_match"))


def follows(text: Column, first: str, then: str) -> Column:
    """Whether ``then`` matches anywhere behind the first match of ``first``."""
    at = F.regexp_instr(text, F.lit(first))
    return (at > 0) & F.substr(text, at).rlike(then)


# Marks of the patterns, as expressions or words, and the confidence of each rule; the first that holds counts.
INSTANCE_OF_CLASS = (r"class", r"_instance\s*=\s*None", 0.8)
INSTANCE_WORDS = (["_instance", "getInstance"], 0.6)
CREATE_WITH_RESULT = (r"def\s+create\w+\s*\(", r"\)\s*->\s*\w+\s*:", 0.7)
FACTORY_CLASS = (r"class\s+\w*Factory", 0.8)
OBSERVER_WORDS = (["subscribe", "notify"], 0.7)
OBSERVER_CLASS = (r"class\s+\w*Observer", 0.8)
DECORATED = (r"@\w+\s*\n\s*def", 0.6)
DECORATOR_CLASS = (r"class\s+\w*Decorator", 0.8)
ASYNC_WORDS = {"python": ["async def", "await "], "javascript": ["async ", "await ", "Promise"], "typescript": ["async ", "await ", "Promise"]}
ASYNC_CONFIDENCE = 0.9


def structural_patterns(code: Column, language: Column) -> Column:
    """A map of patterns that the structure of a code shows, with their confidences.

    Two marks of a rule may be any distance apart, and texts are read whole. A
    null code shows nothing; a null language has no asynchronous marks.
    """
    text = F.coalesce(code, F.lit(""))

    def pick(name: str, *rules: tuple[Column, float]) -> Column:
        value = F.lit(None).cast("double")
        for hit, confidence in reversed(rules):
            value = F.when(hit, confidence).otherwise(value)
        return F.struct(F.lit(name).alias("key"), value.alias("value"))

    def all_words(words: list[str]) -> Column:
        return text.contains(words[0]) & text.contains(words[1])

    waits = F.lit(False)
    for name, words in ASYNC_WORDS.items():
        waits = F.when(language == name, text.contains(words[0]) | text.contains(words[1]) | (text.contains(words[2]) if len(words) > 2 else F.lit(False))).otherwise(waits)
    found = F.array(
        pick("singleton", (follows(text, *INSTANCE_OF_CLASS[:2]), INSTANCE_OF_CLASS[2]), (all_words(INSTANCE_WORDS[0]), INSTANCE_WORDS[1])),
        pick("factory", (follows(text, *CREATE_WITH_RESULT[:2]), CREATE_WITH_RESULT[2]), (text.rlike(FACTORY_CLASS[0]), FACTORY_CLASS[1])),
        pick("observer", (all_words(OBSERVER_WORDS[0]), OBSERVER_WORDS[1]), (text.rlike(OBSERVER_CLASS[0]), OBSERVER_CLASS[1])),
        pick("decorator", (text.rlike(DECORATED[0]), DECORATED[1]), (text.rlike(DECORATOR_CLASS[0]), DECORATOR_CLASS[1])),
        pick("async", (waits, ASYNC_CONFIDENCE)),
    )
    return F.map_from_entries(F.filter(found, lambda x: x["value"].isNotNull()))


def contributions(intent: str) -> Column:
    """Of columns named by FACTORS: an array of (factor, value, weight, confidence, contribution), the largest first."""
    parts = []
    for name, weight in zip(FACTORS, WEIGHTS[intent]):
        value, confidence = F.col(name)["value"], F.col(name)["confidence"]
        parts.append(F.struct((value * weight * confidence).alias("contribution"), F.lit(name).alias("factor"), value.alias("value"), F.lit(weight).alias("weight"), confidence.alias("confidence")))
    return F.sort_array(F.array(*parts), asc=False)


def explained(score: Column, same_language: Column, context: Column, imports: Column, pattern: Column) -> Column:
    """Why a hit is relevant, in words."""
    return F.concat_ws(
        "; ",
        F.when(score > 0.8, "High relevance match").when(score > 0.5, "Good relevance match").otherwise("Partial relevance match"),
        F.when(same_language, "Matches requested language"),
        F.when(context > 0.7, "Similar to current code context"),
        F.when(imports > 0.5, "Uses similar imports/dependencies"),
        F.when(pattern > 0.6, "Follows similar architectural patterns"),
    )


def lexical_rerank(hits: DataFrame, query: Column, text: str, by: str = "query_id") -> DataFrame:
    """Adds ce_score: the keyword overlap of query and text, between 0 and 1 over each query's hits."""
    overlap = jaccard(keywords(query), keywords(F.coalesce(F.col(text), F.lit(""))))
    return hits.withColumn("_overlap", overlap).withColumn("ce_score", clean_minmax(F.col("_overlap"), by)).drop("_overlap")


# What to suggest for an intent, unless the query has one of the words already ("{}" stands for the query).
SUGGESTIONS = {
    "implement": [("{} example implementation", ["example"]), ("{} design pattern", ["pattern"]), ("{} [specify language]", ["python", "javascript", "java", "go", "rust"])],
    "debug": [("{} error handling", ["error", "exception"]), ("fix {}", ["fix"]), ("{} common issues", [])],
    "understand": [("how does {} work", ["how", "what"]), ("{} explanation", []), ("{} documentation", [])],
    "refactor": [("{} best practices", []), ("optimize {}", []), ("{} clean code", [])],
    "test": [("{} unit test", ["unit", "integration"]), ("{} test examples", []), ("mock {}", [])],
    "document": [("{} documentation template", []), ("{} docstring example", []), ("{} API documentation", [])],
}


def suggestions(query: Column, intent: Column, most: int = 3) -> Column:
    """Wordings that may find more, by intent."""
    low = F.lower(query)
    out = F.array().cast("array<string>")
    for name, rules in SUGGESTIONS.items():
        each = [F.when(~has_any(low, words) if words else F.lit(True), F.concat(F.lit(form.split("{}")[0]), query, F.lit(form.split("{}")[1]))) for form, words in rules]
        out = F.when(intent == name, F.slice(F.filter(F.array(*each), lambda x: x.isNotNull()), 1, most)).otherwise(out)
    return out


# Words by which a wording fits an intent.
INTENT_MARKS = {
    "implement": ["how to", "implement", "create", "build", "example", "tutorial"],
    "debug": ["error", "fix", "debug", "not working", "issue", "problem"],
    "understand": ["what is", "how does", "explain", "understand", "documentation"],
    "refactor": ["refactor", "improve", "optimize", "best practice", "clean"],
    "test": ["test", "unit test", "mock", "assert", "coverage"],
    "document": ["document", "docstring", "comment", "readme", "description"],
}


def variant_score(variant: Column, query: Column, intent: Column, key_terms: Column) -> Column:
    """How good a wording of a query is: itself 10, 2 for each key term it keeps, structure 1, intent 3, and its length."""
    low = F.lower(variant)
    n = F.size(F.filter(F.split(F.trim(variant), r"\s+"), lambda w: w != ""))
    ratio = F.length(variant) / F.greatest(F.length(query), F.lit(1))
    fits = F.lit(False)
    for name, marks in INTENT_MARKS.items():
        fits = F.when(intent == name, has_any(low, marks)).otherwise(fits)
    return (
        F.when(variant == query, 10).otherwise(0)
        + 2 * F.size(F.filter(key_terms, lambda t: F.contains(low, t)))
        + F.when(n.between(2, 10), 1).otherwise(0)
        + F.when(fits, 3).otherwise(0)
        + F.when(ratio.between(0.8, 1.2), 1).when(ratio > 1.5, -1).otherwise(0)
    )


def matched_summary(function: Column, name: Column, highlight: Column) -> Column:
    """What a hit is about: its function, else its class, else its first highlight."""
    return F.coalesce(F.concat(F.lit("Function: "), F.nullif(function, F.lit(""))), F.concat(F.lit("Class: "), F.nullif(name, F.lit(""))), F.nullif(highlight, F.lit("")), F.lit("Code match"))


def language_checked(language: Column, known: list[str]) -> Column:
    """(language, error): a known language, or the first one that begins with the same three characters, or why it is refused."""
    low = F.lower(F.trim(language))
    near = F.lit(None).cast("string")
    for name in sorted(known, reverse=True):
        near = F.when(F.substring(low, 1, 3) == name[:3], name).otherwise(near)
    found = F.when(low.isin(known), low).otherwise(near)
    return F.struct(found.alias("language"), F.when(language.isNotNull() & found.isNull(), "unknown language").alias("error"))


def parameters_checked(detail: Column, order: Column, repository: Column) -> Column:
    """(detail, order, repository, error) with defaults for what is missing; a repository keeps letters, digits, dot, underscore, dash and slash."""
    clean = F.regexp_replace(F.coalesce(repository, F.lit("")), r"[^\w./-]", "")
    error = F.when(~detail.isin("full", "compact", "ultra"), "detail").when(~order.isin("relevance", "date", "path", "language"), "order").when(clean.contains(".."), "repository")
    return F.struct(F.coalesce(detail, F.lit("full")).alias("detail"), F.coalesce(order, F.lit("relevance")).alias("order"), F.nullif(clean, F.lit("")).alias("repository"), error.alias("error"))
