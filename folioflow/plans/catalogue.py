"""All core queries by name, with their SQL."""

from __future__ import annotations

from folioflow.plans import detail_queries, page_queries, plan_queries, stat_queries, text_queries

_PARTS = (text_queries, page_queries, plan_queries, stat_queries, detail_queries)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}
