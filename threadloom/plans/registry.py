"""All core queries and, where SQL can state them over whole tables, their SQL."""

from __future__ import annotations

from threadloom.operators import tree_aggregate
from threadloom.plans import activity, ingesting, searching, writing

_MODULES = [tree_aggregate, activity, writing, searching, ingesting]

QUERIES: dict = {}
SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
