"""All queries of this subpackage, by name."""

from __future__ import annotations

from fieldwatch.llm import matching_queries, text_queries

_MODULES = [matching_queries, text_queries]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
