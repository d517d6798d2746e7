"""Operators that a large-scale training-data pipeline needs.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` list what it offers.
"""

from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
