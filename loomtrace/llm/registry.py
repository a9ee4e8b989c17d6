"""All queries of the subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import p1, p4, p7, p8, p9, p10

_MODULES = (p1, p4, p7, p8, p9, p10)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
