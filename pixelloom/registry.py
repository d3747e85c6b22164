"""Queries and oracles of the image operators, by name."""

from __future__ import annotations

from .plans import aggregates, analysis, counting, filters, fitting, functions, joins, sets, sources, windows  # noqa: F401  each module registers its queries
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
