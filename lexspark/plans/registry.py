"""All registered queries and their oracle SQL."""

from __future__ import annotations

from lexspark.plans import clusters, keywords, lexical, records, search

_MODULES = (lexical, records, search, clusters, keywords)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
