"""Canonical forms of source texts: what is left when notation doesn't count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed_lines(text: Column) -> Column:
    """Lines without white space around them; blank ones are left out."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space; what is no JSON keeps its trimmed lines. A null text is null.

    The binary form that parse_json makes has an object's keys in order, so that
    equal values are written alike; an object that repeats a key is no JSON here.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), trimmed_lines(text))


def without_hash_comments(text: Column) -> Column:
    """Trimmed lines without comments that begin with a number sign at a line's start or behind white space."""
    return trimmed_lines(F.regexp_replace(text, r"(?m)(^|\s)#.*$", ""))


def without_slash_comments(text: Column) -> Column:
    """Trimmed lines without block comments, and without line comments (two slashes, no colon before them)."""
    return trimmed_lines(F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*?$", "$1"))


def canonical(text: Column, extension: Column) -> Column:
    """The canonical form for a file extension. Comments of scripts go by their sign alone, also where they stand in a string."""
    return (
        F.when(extension.isin(".js", ".ts"), without_slash_comments(text))
        .when(extension.isin(".py", ".ps1", ".psm1", ".yaml", ".yml", ".toml"), without_hash_comments(text))
        .when(extension == ".json", canonical_json(text))
        .otherwise(trimmed_lines(text))
    )
