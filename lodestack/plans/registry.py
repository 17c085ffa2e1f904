"""All queries of the library, by name."""

from __future__ import annotations

from lodestack.plans import catalog, catalog_sql, maintenance


def queries() -> dict:
    return {**catalog.QUERIES, **maintenance.QUERIES}


def oracle_sql() -> dict:
    return {**catalog_sql.SQL, **maintenance.SQL}
