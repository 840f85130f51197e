"""All registered queries with their comparison SQL."""

from __future__ import annotations

from rollcall.registered import files, history, matching, students

MODULES = (students, matching, history, files)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items() if sql is not None}
