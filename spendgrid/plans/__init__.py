"""Registered queries and their DuckDB equivalents."""

from . import build, relational, risk  # noqa: F401  (they register themselves)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
