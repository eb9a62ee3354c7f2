"""All queries by name, with the SQL that states the same result for an independent engine."""

from __future__ import annotations

from treeline.plans import files, oracles, queries

QUERIES = queries.QUERIES | files.QUERIES
ORACLES = oracles.ORACLES | files.ORACLES

__all__ = ["ORACLES", "QUERIES"]
