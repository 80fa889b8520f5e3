"""Repositories of source files as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.functions.text import LANGUAGES, extension, language_of, mime_of

# Directories that are never read.
EXCLUDED = [".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "dist", "build", "__pycache__", ".mypy_cache", ".pytest_cache", ".coverage", ".vscode", ".idea"]
EXTENSIONS = sorted({e for name, found in LANGUAGES.items() if name not in ("scss", "sass") for e in found})
NAME = r"^[A-Za-z0-9._-]{1,100}$"


def valid_name(name: Column) -> Column:
    return F.coalesce(name.rlike(NAME), F.lit(False))


def ignore_patterns(lines: list[str]) -> list[str]:
    """Regular expressions for the lines of an ignore file (comments, blanks and negations are left out)."""
    out = []
    for line in map(str.strip, lines):
        if not line or line[0] in "#!":
            continue
        anchored, inside = line.startswith("/"), line.rstrip("/").strip("/")
        body = re.escape(inside).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        out.append(("^" if anchored or "/" in inside else "(^|.*/)") + body + "(/.*|$)")
    return out


def wanted(path: Column, ignored: list[str] | None = None, extensions: list[str] | None = None) -> Column:
    """Whether a relative path is to be read: no excluded directory on it, a known extension, not ignored."""
    keep = ~F.exists(F.split(path, "/"), lambda part: part.isin(EXCLUDED)) & extension(path).isin(extensions or EXTENSIONS)
    for pattern in ignore_patterns(ignored or []):
        keep = keep & ~path.rlike(pattern)
    return keep


def scan(spark: SparkSession, root: str, repository: str, ignored: list[str] | None = None) -> DataFrame:
    """repository, path, content, language, mime, last_modified of the files under a root; pruned before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(base) + "/", "")
    kept = files.withColumn("path", path).filter(wanted(F.col("path"), ignored))
    return kept.select(F.lit(repository).alias("repository"), "path", F.decode("content", "utf-8").alias("content"), language_of(F.col("path")).alias("language"), mime_of(F.col("path")).alias("mime"), F.col("modificationTime").alias("last_modified"))


def changed(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The files that a change list (path, status) names and doesn't remove."""
    return files.join(changes.filter("status <> 'removed'").select("path").distinct(), "path", "left_semi")
