"""The engine's queries on the driver's tables, each beside the same query as SQL."""

from __future__ import annotations

from . import catalog, checks, components, facts, history, landing, listing, peer, relational, sinks, texts
from .base import ORACLES, QUERIES

MODULES = (catalog, checks, components, facts, history, landing, listing, peer, relational, sinks, texts)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
