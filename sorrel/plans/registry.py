"""All registered queries and their SQL twins."""

from __future__ import annotations

from sorrel.plans import analyzer_queries, metric_queries, search_queries, text_queries

FLAGSHIP = "hybrid_search"
QUERIES: dict = text_queries.QUERIES | metric_queries.QUERIES | search_queries.QUERIES | analyzer_queries.QUERIES
ORACLE_SQL: dict[str, str] = text_queries.ORACLE_SQL | metric_queries.ORACLE_SQL | search_queries.ORACLE_SQL | analyzer_queries.ORACLE_SQL
