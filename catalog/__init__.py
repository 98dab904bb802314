"""Registered queries with their DuckDB equivalents, one module per operator family."""

from __future__ import annotations

from . import analysis, charts, clusters, findings, outliers, preparation, reduction, tables

MODULES = (tables, preparation, charts, reduction, clusters, outliers, findings, analysis)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
