"""Registered queries over the given tables, with SQL for those that SQL can express."""

from .registry import flagship, oracle_sql, queries

__all__ = ["flagship", "oracle_sql", "queries"]
