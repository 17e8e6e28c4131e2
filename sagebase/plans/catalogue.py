"""Named queries over the test tables, one for each operator or a tight group of them, and their SQL."""

from __future__ import annotations

from sagebase.plans import analytics, cleaning, dialog, jobs, knowledge, retrieval, service, sheets, text, upkeep, windows

_GROUPS = (retrieval, cleaning, text, analytics, knowledge, dialog, service, sheets, upkeep, windows, jobs)
QUERIES = {name: f for g in _GROUPS for name, f in g.QUERIES.items()}
ORACLE_SQL = {name: sql for g in _GROUPS for name, sql in g.ORACLE_SQL.items()}
