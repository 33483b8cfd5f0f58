"""Collects the queries of all workload modules."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}

MODULES = ["expressions", "exact", "evaluation", "labelling", "sharding", "quantizing", "graphs", "searching", "files", "updates", "streams"]


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL, if there is one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"workloads.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
