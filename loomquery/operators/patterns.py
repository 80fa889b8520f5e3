"""The pattern registry and its confidences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values: (type, name, keywords, regular expressions).
PATTERNS = [
    ("design_pattern", "singleton", ["singleton", "instance", "getInstance", "_instance"], [r"class.*Singleton", r"getInstance\s*\(", r"_instance\s*=\s*None", r"__new__.*cls\._instance"]),
    ("design_pattern", "factory", ["factory", "create", "build", "make", "produce"], [r"class.*Factory", r"create\w+\s*\(", r"build\w+\s*\(", r"@staticmethod.*create"]),
    ("design_pattern", "observer", ["observer", "subscribe", "notify", "listener", "event"], [r"class.*Observer", r"subscribe\s*\(", r"notify.*\(", r"addEventListener", r"addListener"]),
    ("design_pattern", "strategy", ["strategy", "algorithm", "policy"], [r"class.*Strategy", r"setStrategy\s*\(", r"execute.*Strategy"]),
    ("design_pattern", "decorator", ["decorator", "wrapper", "enhance"], [r"@\w+", r"class.*Decorator", r"wrap\w+\s*\(", r"@wraps"]),
    ("architectural", "mvc", ["model", "view", "controller", "mvc"], [r"class.*Controller", r"class.*Model", r"class.*View"]),
    ("architectural", "microservice", ["service", "api", "endpoint", "route"], [r"@app\.route", r"@router\.(get|post|put|delete)", r"class.*Service"]),
    ("architectural", "repository", ["repository", "dao", "persistence"], [r"class.*Repository", r"class.*DAO", r"save\s*\(", r"find.*By"]),
    ("error_handling", "try_catch", ["try", "catch", "except", "finally", "error"], [r"try\s*:", r"except.*:", r"catch\s*\(", r"finally\s*:", r"raise\s+\w+Error"]),
    ("error_handling", "validation", ["validate", "check", "verify", "assert"], [r"validate\w+\s*\(", r"assert\s+", r"if.*is.*None", r"if\s+not\s+.*:\s*raise"]),
    ("error_handling", "vector_dimension_mismatch", ["dimension", "shape", "size", "mismatch", "vector", "embedding"], [r"len\s*\(.*vector.*\)\s*!=", r"\.shape\[0\]\s*!=", r"dimension.*mismatch", r"ValueError.*dimension"]),
    ("error_handling", "embedding_validation", ["embedding", "vector", "None", "NaN", "null", "isnan"], [r"if\s+.*embedding.*is\s+None", r"np\.isnan\s*\(.*embedding", r"embedding\s*==\s*None"]),
    ("testing", "unit_test", ["test", "assert", "expect", "mock"], [r"def\s+test_\w+", r"class.*Test", r"assert.*==", r"@pytest\.", r"expect\(.*\)"]),
    ("testing", "integration_test", ["integration", "e2e", "fixture", "setup"], [r"@pytest\.fixture", r"setUp\s*\(", r"tearDown\s*\("]),
    ("framework_specific", "django", ["django", "models", "views", "serializers"], [r"from django", r"class.*\(models\.Model\)", r"class.*View"]),
    ("framework_specific", "react", ["react", "component", "useState", "useEffect"], [r"import.*from.*react", r"useState\s*\(", r"function.*Component"]),
    ("framework_specific", "fastapi", ["fastapi", "router", "dependency", "pydantic"], [r"from fastapi", r"@app\.(get|post|put|delete)", r"@router\.(get|post|put|delete)", r"Depends\s*\("]),
    ("code_structure", "initialization", ["init", "setup", "constructor"], [r"def\s+__init__\s*\(", r"self\.\w+\s*=", r"super\(\).__init__"]),
    ("code_structure", "api_endpoint", ["endpoint", "route", "api", "handler"], [r"@app\.(get|post|put|delete)\(", r"@router\.(get|post|put|delete)\(", r"async\s+def\s+\w+.*request"]),
]
LEAST = 0.1


def _share(hits: list[Column]) -> Column:
    total = F.lit(0)
    for h in hits:
        total = total + F.when(h, 1).otherwise(0)
    return total / F.lit(len(hits))


def required(expression: str) -> str:
    """The longest stretch of plain characters that every match of an expression holds; empty if there is none."""
    plain = re.sub(r"\\([.\[\]()])", lambda m: {".": "\0", "[": "\1", "]": "\2", "(": "\3", ")": "\4"}[m[1]], expression)
    plain = re.sub(r"\([^()]*\)", "\n", plain)  # alternatives
    plain = re.sub(r"\\[a-z]|[.]|.[*?]", "\n", plain)
    return max(re.split(r"[\n*+?|^$]", plain), key=len).translate({0: ".", 1: "[", 2: "]", 3: "(", 4: ")"})


def _found(text: Column, expression: str) -> Column:
    """A match; most texts lack its plain part and are not matched at all."""
    plain = required(expression)
    return F.contains(text, F.lit(plain)) & text.rlike(expression) if plain else text.rlike(expression)


def confidences(code: Column, context: Column | None = None, types: list[str] | None = None, names: list[str] | None = None) -> Column:
    """An array of (pattern_type, pattern, confidence) above the least confidence, of all patterns or those of some types or names.

    Keywords count 0.4, regular expressions 0.5 and keywords in the context 0.1, each by the share that is found.
    """
    # Bound once: the text in lower case is otherwise made anew for each of the keywords.
    once = F.struct(F.coalesce(code, F.lit("")).alias("text"), F.lower(F.coalesce(code, F.lit(""))).alias("low"))
    return F.get(F.transform(F.array(once), lambda x: _confidences(x["text"], x["low"], context, types, names)), F.lit(0))


def _confidences(text: Column, low: Column, context: Column | None, types: list[str] | None, names: list[str] | None) -> Column:
    out = []
    for kind, name, words, expressions in PATTERNS:
        if (types is not None and kind not in types) or (names is not None and name not in names):
            continue
        total = _share([F.contains(low, F.lit(w.lower())) for w in words]) * 0.4 + _share([_found(text, e) for e in expressions]) * 0.5
        if context is not None:
            total = total + _share([F.contains(F.lower(F.coalesce(context, F.lit(""))), F.lit(w.lower())) for w in words]) * 0.1
        out.append(F.struct(F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern"), F.least(F.lit(1.0), total).alias("confidence")))
    return F.filter(F.array(*out), lambda x: x["confidence"] > LEAST)


def query_confidences(query: Column, context: Column | None = None, least: float = 0.3) -> Column:
    """An array of (pattern_type, pattern, confidence) above ``least`` for the words of a request.

    Keywords count 0.6, expressions (whatever the case) 0.4 and keywords in the
    context 0.2; 1 at most. Keywords with capitals are never found in a request,
    which is lower-cased.
    """
    low, other = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(context, F.lit(""))) if context is not None else F.lit("")
    out = []
    for kind, name, words, expressions in PATTERNS:
        total = _share([F.contains(low, F.lit(w)) for w in words]) * 0.6 + _share([low.rlike(f"(?i){e}") for e in expressions]) * 0.4 + _share([F.contains(other, F.lit(w)) for w in words]) * 0.2
        out.append(F.struct(F.lit(kind).alias("pattern_type"), F.lit(name).alias("pattern"), F.least(F.lit(1.0), total).alias("confidence")))
    return F.filter(F.array(*out), lambda x: x["confidence"] > least)


def recognise(files: DataFrame, key: str, text: str, context: str | None = None, names: list[str] | None = None) -> DataFrame:
    """key, pattern_type, pattern, confidence; only the patterns of ``names``, if they are given."""
    return files.select(key, F.inline_outer(confidences(F.col(text), F.col(context) if context else None, names=names))).filter("pattern is not null")


def dominant(found: DataFrame, key: str) -> DataFrame:
    """The most confident pattern of each file; ties go to the first by name."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("confidence"), "pattern_type", "pattern"))
    return found.withColumn("_n", place).filter("_n = 1").drop("_n")
