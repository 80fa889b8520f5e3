"""Text and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9_]+"
CONTENT_LIMIT = 32_000

# Words that carry no meaning for keyword overlap.
KEYWORD_STOP_WORDS = ["the", "is", "at", "which", "on", "and", "a", "an", "as", "by", "for", "if", "in", "it", "of", "or", "to"]

# File extensions by language; anything else is plain text.
LANGUAGES = {
    "python": [".py"],
    "javascript": [".js", ".mjs", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "cpp": [".cpp"],
    "c": [".c"],
    "csharp": [".cs"],
    "go": [".go"],
    "rust": [".rs"],
    "php": [".php"],
    "ruby": [".rb"],
    "swift": [".swift"],
    "kotlin": [".kt"],
    "scala": [".scala"],
    "r": [".r"],
    "markdown": [".md"],
    "json": [".json"],
    "yaml": [".yaml", ".yml"],
    "xml": [".xml"],
    "html": [".html"],
    "css": [".css"],
    "scss": [".scss"],
    "sass": [".sass"],
}

# File extensions by MIME type; anything else is an octet stream.
MIME_TYPES = {
    "text/x-python": [".py"],
    "application/x-sh": [".sh", ".bash", ".zsh"],
    "application/javascript": [".js", ".mjs"],
    "text/typescript": [".ts"],
    "text/tsx": [".tsx"],
    "text/jsx": [".jsx"],
    "application/json": [".json"],
    "text/markdown": [".md"],
    "text/plain": [".txt"],
    "text/html": [".html"],
    "text/css": [".css"],
    "text/yaml": [".yaml", ".yml"],
    "application/xml": [".xml"],
    "text/x-java-source": [".java"],
    "text/x-c": [".c", ".h"],
    "text/x-c++": [".cpp", ".hpp"],
    "text/rust": [".rs"],
    "text/x-go": [".go"],
    "text/x-ruby": [".rb"],
    "application/x-php": [".php"],
    "text/x-csharp": [".cs"],
    "text/x-kotlin": [".kt"],
    "text/x-scala": [".scala"],
    "text/x-r-source": [".r"],
    "text/x-dockerfile": [".dockerfile"],
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def truncated(content: Column, limit: int = CONTENT_LIMIT) -> Column:
    """At most ``limit`` characters; a cut text ends in three dots."""
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit - 3), F.lit("..."))).otherwise(content)


def is_truncated(content: Column, limit: int = CONTENT_LIMIT) -> Column:
    return F.coalesce(F.length(content) > limit, F.lit(False))


def extension(path: Column) -> Column:
    """The last extension in lower case with its dot, or an empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _lookup(key: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for value, keys in table.items():
        out = F.when(key.isin(keys), value).otherwise(out)
    return out


def language_of(path: Column, default: str = "text") -> Column:
    return _lookup(extension(path), LANGUAGES, default)


def mime_of(path: Column) -> Column:
    return _lookup(extension(path), MIME_TYPES, "application/octet-stream")


def strip_tags(text: Column) -> Column:
    """Without tags, with plain blanks, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "&nbsp;| ", " "))


def highlights(found: Column, limit: int = 200) -> Column:
    """An array of snippets: tags stripped, cut at ``limit``, blanks dropped."""
    return F.filter(F.transform(found, lambda x: F.substring(strip_tags(x), 1, limit)), lambda x: F.length(F.trim(x)) > 0)


def headline(content: Column, limit: int = 120, comment: str = "#|//|/\\*|\\*") -> Column:
    """The first line that is neither blank nor a comment, cut at ``limit`` with an ellipsis."""
    line = F.get(F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 0) & ~x.rlike(f"^({comment})")), F.lit(0))
    return F.coalesce(F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line), F.lit(""))


def snippet(content: Column, lines: int) -> Column:
    """The headline and the lines that follow the first one, ``lines`` in all."""
    return F.concat_ws("\n", headline(content), F.slice(F.split(content, "\n"), 2, max(0, lines - 1)))


def exact_terms(query: Column) -> Column:
    """Quoted phrases, numbers and versions, and called names, each once in order of kind."""
    quoted = F.transform(F.regexp_extract_all(query, F.lit("\"[^\"]+\"|'[^']+'"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    numbers = F.regexp_extract_all(query, F.lit(r"(?U)(?<!\w)(\d+(?:\.\d+)+|\d{2,})(?![\w.])"), F.lit(1))
    calls = F.regexp_extract_all(query, F.lit(r"(?U)(\w+)\s*\("), F.lit(1))
    return F.array_distinct(F.concat(quoted, numbers, calls))


def keywords(text: Column) -> Column:
    """Distinct identifiers of three letters or more without stop words."""
    return keywords_of(tokens(text))


def keywords_of(words: Column) -> Column:
    """The keywords among ``tokens``."""
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]") & ~w.isin(KEYWORD_STOP_WORDS)))


def normalised(text: Column) -> Column:
    """White space collapsed, lower case: what two hits must share to be one."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty or null."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_damped(x: Column) -> Column:
    return F.when(x > 0, F.least(F.lit(1.0), F.log(1 + 4 * x) / F.log(F.lit(5.0)))).otherwise(0.0)


def unit_range(value: Column, low: Column, high: Column) -> Column:
    """Min-max into [0, 1]; neutral 0.5 for no spread, NaN and infinities."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (high == low)
    return F.when(odd, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))))


def path_proximity(here: Column, there: Column, same_project: Column, same_language: Column) -> Column:
    """1 the same file, 0.7 its directory, 0.5 the directory above, 0.3 the project, 0.1 the language."""

    def above(path: Column, up: int) -> Column:
        parts = F.split(path, "/")
        return F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - up))

    deep = (F.size(F.split(here, "/")) > 2) & (F.size(F.split(there, "/")) > 2)
    ladder = (
        F.when(here == there, 1.0)
        .when(above(here, 1) == above(there, 1), 0.7)
        .when(deep & (above(here, 2) == above(there, 2)), 0.5)
        .when(same_project, 0.3)
        .when(same_language, 0.1)
        .otherwise(0.0)
    )
    return F.when((F.length(here) > 0) & (F.length(there) > 0), ladder).otherwise(0.0)


def snake_case(name: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(apart, r"[\s\-]+", "_"))


def pascal_case(name: Column) -> Column:
    return F.concat_ws("", F.transform(F.split(snake_case(name), "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))


def camel_case(name: Column) -> Column:
    whole = pascal_case(name)
    return F.concat(F.lower(F.substring(whole, 1, 1)), F.substring(whole, 2, 1_000_000))


def kebab_case(name: Column) -> Column:
    return F.replace(snake_case(name), F.lit("_"), F.lit("-"))


def upper_case(name: Column) -> Column:
    return F.upper(snake_case(name))


def naming_style(name: Column) -> Column:
    return (
        F.when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "upper")
        .when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "snake")
        .when(name.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(name.rlike("^([A-Z][a-z0-9]*)+$"), "pascal")
        .otherwise("other")
    )


# What differs between deployments of one file, in order of masking.
ENVIRONMENT = [
    r"https?://[\w\.-]+",
    r"(?i)\b(eastus|westeurope|centralus|uksouth|japaneast|australiaeast|northeurope|westus2)\b",
    r"\b\d+\.\d+\.\d+\b",
    r"\b(AZURE_[A-Z0-9_]+|ACS_[A-Z0-9_]+)\b",
]


def masked_environment(text: Column) -> Column:
    """URLs, regions, versions and settings' names as numbered tags, so that copies that differ in them are equal."""
    for nth, pattern in enumerate(ENVIRONMENT):
        text = F.regexp_replace(text, pattern, f"<ENV_{nth}>")
    return text


def has_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


# Words that tell what a hit is about.
FAILING = ["try", "except", "catch", "error", "exception"]
FAILING_VECTORS = ["vector", "embedding", "dimension", "nan"]
CODING = ["def", "function", "class", "implement"]
CODING_VECTORS = ["vector_search", "similarity", "embedding"]
CONFIGURING = ["config", "settings", "index", "schema"]
TESTING = ["test_", "assert", "mock", "fixture"]
DOCUMENTING = ["documentation", "readme", "comment"]


def context_type(content: Column, explanation: Column | None = None) -> Column:
    """What a hit is about, by the first group of words found."""
    text, said = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(explanation if explanation is not None else F.lit(""), F.lit("")))
    return (
        F.when(has_any(text, FAILING), F.when(has_any(text, FAILING_VECTORS), "vector_error_handling").otherwise("error_handling"))
        .when(has_any(text, CODING), F.when(has_any(text, CODING_VECTORS), "vector_implementation").otherwise("implementation"))
        .when(has_any(text, CONFIGURING), "configuration")
        .when(has_any(text, TESTING), "testing")
        .when(has_any(said, DOCUMENTING), "documentation")
        .otherwise("general")
    )


def repository_of(path: Column) -> Column:
    """The directory before a source or library directory, else the first directory."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, lambda p: p.isin("src", "lib", "app")), True)
    return F.when(at > 1, F.get(parts, (at - 2).cast("int"))).when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")


def duration_minutes(iso: Column) -> Column:
    """PTnH or PTnM as minutes; null for anything else."""
    hours, minutes = F.regexp_extract(iso, r"^PT(\d+)H$", 1), F.regexp_extract(iso, r"^PT(\d+)M$", 1)
    return F.when(hours != "", hours.cast("long") * 60).when(minutes != "", minutes.cast("long"))


def sanitised(text: Column, limit: int = 10_000) -> Column:
    """Without scripts, frames, event handlers and script links, cut at ``limit``."""
    out = F.regexp_replace(text, r"(?is)<script.*?</script>|<iframe.*?</iframe>", "")
    out = F.regexp_replace(out, r"(?i)javascript:|\bon\w+\s*=", "")
    return F.substring(out, 1, limit)
