"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from wordloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
