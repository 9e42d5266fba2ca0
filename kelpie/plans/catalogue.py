"""Registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from kelpie.plans import corpus, lexicon, records, warehouse

_MODULES = (corpus, warehouse, lexicon, records)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
