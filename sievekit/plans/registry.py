"""Collects the queries and their SQL counterparts from the plan modules."""

from __future__ import annotations

from . import audits, lookups, models, scoring, splits

MODULES = (splits, audits, scoring, lookups, models)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
