"""Registry of this subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

# imported here, not later: without one of their libraries the subpackage as a whole is absent
from graphloom.llm import components_queries, forest_queries, leaks_queries, neardup_queries, packing_queries, provenance_queries, syntax_queries, textstats_queries

MODULES = (components_queries, forest_queries, packing_queries, leaks_queries, neardup_queries, textstats_queries, provenance_queries, syntax_queries)


def llm_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def llm_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
