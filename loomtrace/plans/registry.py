"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import maintain, p2, p3, p5, p6, relations, search, sources, text, tree

_MODULES = (search, text, tree, relations, sources, maintain, p2, p3, p5, p6)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
