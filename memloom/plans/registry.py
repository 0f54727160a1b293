"""Registered queries and their SQL oracles."""

from __future__ import annotations

from . import graph_queries, memory_queries, notes_queries, schema_queries, search_queries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (notes_queries, graph_queries, search_queries, memory_queries, schema_queries):
    QUERIES |= _m.Q
    ORACLES |= _m.O

FLAGSHIP = search_queries.context_budget
