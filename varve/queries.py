"""Queries of the engine on the driver's tables, with the same queries as SQL."""

from __future__ import annotations

from varve.catalogue import oracle_sql, queries
from varve.catalogue.history import flagship

__all__ = ["flagship", "oracle_sql", "queries"]
