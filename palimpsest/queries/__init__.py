"""Queries by name over the driver's tables, and SQL for those that SQL can express."""

from palimpsest.queries import memory_queries, more_queries, search_queries

QUERIES = memory_queries.QUERIES | search_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL = memory_queries.ORACLE_SQL | search_queries.ORACLE_SQL | more_queries.ORACLE_SQL
