"""All queries of the engine's own operators, and SQL to check them."""

from __future__ import annotations

from .plans import base, outputs, records, series

QUERIES = base.QUERIES
ORACLE = base.ORACLE

__all__ = ["ORACLE", "QUERIES", "outputs", "records", "series"]
