"""Rules as a table: conditions over an index's figures, compiled to columns, all matches in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GIGABYTE = 1 << 30


@dataclass(frozen=True)
class Rule:
    """A condition (SQL over the figures' columns) and what it advises; ``reason`` is SQL that gives a text."""

    condition: str
    priority: str
    action: str
    reason: str


# When an index should be built anew, and what a large one should change.
REINDEX = [
    Rule("invalid > 0", "high", "drop-rebuild", "concat('Schema validation failed: ', invalid, ' rows')"),
    Rule("warnings > 0", "medium", "schema-update", "concat('Schema warnings: ', warnings, ' rows')"),
    Rule("documents = 0", "high", "repository", "'Index is empty'"),
    Rule(f"bytes > {10 * GIGABYTE}", "low", "optimize", "'Index size exceeds 10GB, consider optimization'"),
]
HINTS = [
    Rule("documents > 1000000", "medium", "performance", "'Consider partitioning data across multiple indexes for better performance'"),
    Rule(f"bytes > {10 * GIGABYTE}", "medium", "storage", f"concat('Index size is ', format_number(bytes / {GIGABYTE}, '0.00'), 'GB. Consider cleanup or archival')"),
    Rule(f"bytes > {50 * GIGABYTE}", "high", "storage", f"concat('Index size is ', format_number(bytes / {GIGABYTE}, '0.00'), 'GB. Approaching service limits')"),
    Rule("fields > 1000", "medium", "schema", "concat('Index has ', fields, ' fields. Consider schema optimization')"),
    Rule("dimensions > 3000", "low", "vectors", "concat('High vector dimensionality (', dimensions, ' total). Consider dimension reduction')"),
]


def matches(figures: DataFrame, rules: list[Rule]) -> DataFrame:
    """``figures`` with advice: (nth, priority, action, reason) of every rule that holds, in the rules' order. A condition that can't be told doesn't hold."""
    each = [F.when(F.expr(r.condition), F.struct(F.lit(i).alias("nth"), F.lit(r.priority).alias("priority"), F.lit(r.action).alias("action"), F.expr(r.reason).alias("reason"))) for i, r in enumerate(rules)]
    return figures.withColumn("advice", F.filter(F.array(*each), lambda x: x.isNotNull()))


def plan(figures: DataFrame, rules: list[Rule] = REINDEX) -> DataFrame:
    """``figures`` with advice and needs_reindex: whether any of it has high priority."""
    found = matches(figures, rules)
    return found.withColumn("needs_reindex", F.exists("advice", lambda a: a["priority"] == "high"))
