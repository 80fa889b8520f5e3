"""Wordings of a query: one array of variants for each way to make them, filtered, scored and ranked as rows.

Everything is a Column over the words of a lower-cased query; a word table is a
literal map. Null and blank queries have no variants but themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions.text import has_any, keywords
from loomquery.operators.explain import variant_score
from loomquery.operators.understanding import VERBS, acceptable, words

# Nouns and their variations.
NOUNS = {
    "function": ["function", "method", "procedure", "routine", "operation"],
    "variable": ["variable", "var", "parameter", "argument", "value"],
    "class": ["class", "type", "object", "entity", "model"],
    "error": ["error", "exception", "bug", "issue", "problem"],
    "database": ["database", "db", "datastore", "storage", "repository"],
    "api": ["api", "endpoint", "interface", "service", "route"],
    "authentication": ["authentication", "auth", "login", "signin", "authorization"],
    "component": ["component", "module", "unit", "element", "widget"],
}

# Short forms of words.
SHORT_FORMS = {
    "authentication": "auth",
    "authorization": "authz",
    "database": "db",
    "application": "app",
    "configuration": "config",
    "environment": "env",
    "development": "dev",
    "production": "prod",
    "repository": "repo",
}

# Openings of questions, and what the rest is called as a statement.
STATEMENTS = {"how to ": "tutorial", "what is ": "explanation", "why does ": "reason"}
QUESTION_WORDS = ["how", "what", "why", "when", "where"]

# Forms of a query about an object, a concept or an error.
FORMS = {
    "object": ["{} example", "{} implementation", "{} sample code", "{} usage"],
    "concept": ["what is {}", "{} definition", "{} meaning", "{} explanation", "define {}"],
    "error": ["{} error", "fix {}", "resolve {}", "{} troubleshooting", "debug {}"],
}

# Words to put before and after a query by its intent.
INTENT_WORDS = {
    "implement": ["example", "tutorial", "how to", "step by step"],
    "debug": ["fix", "solve", "error", "not working"],
    "understand": ["explanation", "how does", "what is", "documentation"],
    "refactor": ["best practice", "improve", "optimize", "clean code"],
    "test": ["unit test", "test case", "mock", "assertion"],
    "document": ["documentation", "docstring", "comment", "example"],
}

# What belongs to a language and to a framework.
LANGUAGE_FORMS = {"python": ["python syntax"], "javascript": ["javascript es6"], "typescript": ["javascript es6"]}
FRAMEWORK_FORMS = {
    "django": ["django orm", "django views", "django models"],
    "react": ["react hooks", "react component", "react state"],
    "spring": ["spring boot", "spring bean", "spring mvc"],
}

# Words that carry no content of their own.
EMPTY_WORDS = (
    "a an the is are was were been have has had do does did will would could should may might must can this that these those "
    "i you he she it we they them their what which who when where why how all each every some any few more most other such only "
    "own same so than too very just but and or if then else at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further once"
).split()

_NONE = "array<string>"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(_NONE)


def _table(entries: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for word, others in entries.items() for x in (F.lit(word), _literals(others))])


def word_table(per_word: int = 3) -> dict[str, list[str]]:
    """Each known verb, noun, long and short form, and the words that may stand for it."""
    out = {word: [o for o in others if o != word][:per_word] for table in (VERBS, NOUNS) for word, others in table.items()}
    for long, short in SHORT_FORMS.items():
        out[long] = list(dict.fromkeys([*out.get(long, []), short]))
        out[short] = list(dict.fromkeys([*out.get(short, []), long]))
    return out


def _with(own: Column, i: Column, put: Column, skipped: int = 1) -> Column:
    """The words as a text, with ``put`` for ``skipped`` words from place i (from 0) on."""
    return F.concat_ws(" ", F.slice(own, F.lit(1), i), put, F.slice(own, i + 1 + skipped, F.greatest(F.size(own) - i - skipped, F.lit(0))))


def _present(variants: Column) -> Column:
    return F.filter(variants, lambda v: v.isNotNull())


def substituted(own: Column, table: dict[str, list[str]]) -> Column:
    """One known word replaced at a time, by each of its others."""
    others = _table(table)
    return F.flatten(_present(F.transform(own, lambda w, i: F.transform(others[w], lambda o: _with(own, i, F.array(o))))))


def swapped(own: Column, most: int = 5) -> Column:
    """Neighbours with content exchanged, in queries of two to ``most`` words."""
    full = lambda w: ~w.isin(EMPTY_WORDS)
    pairs = F.transform(own, lambda w, i: F.when((i + 1 < F.size(own)) & full(w) & full(F.get(own, i + 1)), _with(own, i, F.array(F.get(own, i + 1), w), 2)))
    return F.when(F.size(own).between(2, most), _present(pairs)).otherwise(F.array().cast(_NONE))


def rephrased(query: Column, own: Column) -> Column:
    """A question as a statement, or a statement that opens with a known verb or noun as a question."""
    asks = [F.when(F.startswith(query, F.lit(opening)), F.concat(F.substr(query, F.lit(len(opening) + 1)), F.lit(" " + kind))) for opening, kind in STATEMENTS.items()]
    first = F.get(own, F.lit(0))
    told = F.when(first.isin(list(VERBS)), F.concat(F.lit("how to "), query)).when(first.isin(list(NOUNS)), F.concat(F.lit("what is "), query))
    return _present(F.array(*asks, F.when(~query.rlike(f"^({'|'.join(QUESTION_WORDS)})"), told)))


def gerunds(own: Column) -> Column:
    """Known verbs in -ing, one at a time."""
    ing = lambda w: F.concat(F.when(w.rlike("[^e]e$"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w), F.lit("ing"))
    return _present(F.transform(own, lambda w, i: F.when(w.isin(list(VERBS)), _with(own, i, F.array(ing(w))))))


def _filled(forms: list[str], what: Column) -> Column:
    return F.array(*[F.concat(F.lit(f.split("{}")[0]), what, F.lit(f.split("{}")[1])) for f in forms])


def templated(query: Column, own: Column, intent: Column) -> Column:
    """Forms for the object of a verb, the concept of a question and the name of an error."""
    content = F.filter(own, lambda w: ~w.isin(EMPTY_WORDS))
    verb = F.get(F.filter(own, lambda w: w.isin(list(VERBS))), F.lit(0))
    after = F.filter(F.slice(own, F.array_position(own, verb).cast("int") + 1, F.size(own) + 1), lambda w: ~w.isin(EMPTY_WORDS))
    thing = F.when(F.size(after) > 0, F.concat_ws(" ", F.slice(after, 1, 2)))
    concept = F.when((F.size(content) > 0) & (F.contains(query, F.lit("what")) | (intent == "understand")), F.concat_ws(" ", F.slice(content, 1, 2)))
    named = F.coalesce(*[F.nullif(F.regexp_extract(query, p, 1), F.lit("")) for p in (r"(?:error|exception):\s*(\w+)", r"(\w+)\s*(?:error|exception)", r"(?:fix|debug|resolve)\s+(\w+)")])
    wrong = F.when((intent == "debug") | has_any(query, ["error", "fix", "debug"]), named)
    return _present(F.concat(_filled(FORMS["object"], thing), _filled(FORMS["concept"], concept), _filled(FORMS["error"], wrong)))


def by_intent(query: Column, intent: Column) -> Column:
    """The intent's words before and after a query that lacks them."""
    lacking = F.filter(F.coalesce(_table(INTENT_WORDS)[intent], F.array().cast(_NONE)), lambda k: ~F.contains(query, k))
    return F.flatten(F.transform(lacking, lambda k: F.array(F.concat_ws(" ", query, k), F.concat_ws(" ", k, query))))


def by_context(query: Column, language: Column, framework: Column, imports: Column) -> Column:
    """The query with its surroundings: language, framework and the last names of the imports that it touches (two at most)."""
    low_language, low_framework = F.lower(language), F.lower(framework)
    touched = F.filter(imports, lambda i: F.exists(F.split(F.lower(i), r"\."), lambda part: (F.length(part) > 2) & F.contains(query, part)))
    last = F.filter(F.transform(F.slice(touched, 1, 2), lambda i: F.element_at(F.split(i, r"\."), -1)), lambda name: ~F.contains(query, name))
    parts = [F.array(low_language, low_framework), _table(LANGUAGE_FORMS)[low_language], _table(FRAMEWORK_FORMS)[low_framework], last]
    more = _present(F.concat(*[F.coalesce(p, F.array().cast(_NONE)) for p in parts]))
    return F.transform(F.filter(more, lambda m: ~F.contains(query, m)), lambda m: F.concat_ws(" ", query, m))


def rewrites(queries: DataFrame, key: str, text: str, intent: str, language: str | None = None, framework: str | None = None, imports: str | None = None, most: int = 10) -> DataFrame:
    """key, rank (from 1), variant, score: the ``most`` best wordings, the lower-cased query itself among them.

    A variant shares half of the query's words, is at most twice as long and
    repeats no word; ties go to the variant first in order. A null query counts
    as empty. Ranking needs one shuffle, of the variants by key.
    """
    absent = lambda name, kind: F.col(name) if name else F.lit(None).cast(kind)
    asked = queries.select(
        F.col(key), F.concat_ws(" ", words(F.coalesce(text, F.lit("")))).alias("_q"), F.col(intent).alias("_intent"),
        absent(language, "string").alias("_language"), absent(framework, "string").alias("_framework"), absent(imports, _NONE).alias("_imports"),
    ).withColumn("_w", words(F.col("_q")))
    q, own, kind = F.col("_q"), F.col("_w"), F.col("_intent")
    made = F.concat(swapped(own), rephrased(q, own), gerunds(own), substituted(own, word_table()), templated(q, own, kind), by_intent(q, kind), by_context(q, F.col("_language"), F.col("_framework"), F.col("_imports")))
    each = asked.select(key, "_q", "_intent", F.slice(keywords(q), 1, 5).alias("_terms"), F.explode(F.array_distinct(F.concat(F.array(q), made))).alias("variant"))
    fit = each.filter((F.col("variant") == q) | acceptable(F.col("variant"), q))
    scored = fit.select(key, "variant", variant_score(F.col("variant"), q, kind, F.col("_terms")).cast("long").alias("score"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "variant"))
    return scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most).select(key, "rank", "variant", "score")
