"""All queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from reqloom.plans import q_graph, q_more, q_stage, q_text
from reqloom.plans.fixtures import for_duckdb

_MODULES = (q_text, q_stage, q_graph, q_more)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: for_duckdb(v) for m in _MODULES for k, v in m.SQL.items()}
