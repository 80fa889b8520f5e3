"""All queries over the given tables by name, with their SQL."""

from __future__ import annotations

from loomquery.plans import advised, alike, analytics, behaviour, code, contextual, data, facts, fed, formed, joined, kept, learned, ranked, rewritten, scoped, search, searched, shaped, stocked, streams, texts
from loomquery.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "advised", "alike", "analytics", "behaviour", "code", "contextual", "data", "facts", "fed", "formed", "joined", "kept", "learned", "ranked", "rewritten", "scoped", "search", "searched", "shaped", "stocked", "streams", "texts"]
