"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from . import rule_queries, system_queries

_MODULES = [rule_queries, system_queries]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
