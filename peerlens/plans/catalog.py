"""All queries of the analytics operators by name, with their SQL oracles."""

from __future__ import annotations

from . import metric_queries, read_queries, report_queries, season_queries, value_queries  # noqa: F401  their queries are registered as they are read
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
