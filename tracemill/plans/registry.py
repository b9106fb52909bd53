"""Registered queries of the trace operators and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: modules of this package with a ``registry``
AREAS = ("detectors", "scoring", "telemetry", "analysis", "records", "governance", "sources")


def _areas() -> list:
    return [import_module(f"tracemill.plans.{area}").registry for area in AREAS]


def queries() -> dict:
    return {name: query for area in _areas() for name, query in area.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in _areas() for name, sql in area.sql.items()}
