"""Named queries over the given tables, with their SQL, and method pipelines."""

from __future__ import annotations

from importlib import import_module

MODULES = ("trace_queries", "more_queries", "stream_queries", "text_queries", "extra_queries", "source_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tracewell.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tracewell.plans.{m}").ORACLE.items()}
