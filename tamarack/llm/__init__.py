"""Operators for training data. Nothing else in the package imports this one."""

from tamarack.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
