"""All queries of the core by name, with the SQL that checks them."""

from __future__ import annotations

from skylattice.plans import checks, problems, projections, search, sight, space, texts, tracking

MODULES = (tracking, projections, texts, space, sight, search, checks, problems)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
