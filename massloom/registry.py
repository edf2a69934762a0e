"""Every registered query of the library with its oracle."""

from __future__ import annotations

from massloom.plans.catalog import CATALOG


def queries():
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
