"""Search filters as Column predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FIELDS = ("content", "function_name", "class_name", "docstring")
_UNSAFE = r"(?i)[();]|--| or | and "


def equals(field: str, value: str | None) -> Column | None:
    return None if value is None else F.col(field) == F.lit(value)


def exclude_terms(terms: list[str], text: Column, tags: Column | None = None) -> Column | None:
    """No term among the text's tokens, nor among the tags."""
    from loomquery.functions.text import tokens

    clauses = [~F.array_contains(tokens(text), t.lower()) for t in terms]
    if tags is not None:
        clauses += [~F.coalesce(F.array_contains(F.transform(tags, F.lower), t.lower()), F.lit(False)) for t in terms]
    return combine(*clauses)


def exact_terms(terms: list[str], fields: list[Column]) -> Column | None:
    """Every term in at least one field. A term that looks like an expression matches nothing."""
    clauses = []
    for term in terms:
        hits = [F.coalesce(F.contains(f, F.lit(term)), F.lit(False)) for f in fields]
        clauses.append(reduce(Column.__or__, hits) & ~F.lit(term).rlike(_UNSAFE))
    return combine(*clauses)


def combine(*clauses: Column | None) -> Column | None:
    """All clauses that are there."""
    there = [c for c in clauses if c is not None]
    return reduce(Column.__and__, there) if there else None


def not_blank(content: Column, docstring: Column | None = None) -> Column:
    text = F.coalesce(F.nullif(F.trim(content), F.lit("")), F.trim(docstring) if docstring is not None else F.lit(""))
    return F.length(F.coalesce(text, F.lit(""))) > 0


def repository_prefix(repository: Column, prefix: str) -> Column:
    return F.startswith(F.lower(repository), F.lit(prefix.lower()))


def lexical_only(query: Column) -> Column:
    """Whether a query has operators, is mostly punctuation or is too long for semantic search."""
    return query.rlike(r"\b(AND|OR|NOT)\b|[{}\[\]();=<>]") | (F.length(query) > 500)
