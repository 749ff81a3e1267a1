"""Registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from vantle.plans import catalog, dataset_plans, vector_plans  # noqa: F401


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.SQL)
