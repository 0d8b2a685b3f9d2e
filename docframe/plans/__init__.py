"""Plan shapes that stay balanced when one key holds a large share of the rows, and the queries."""

from __future__ import annotations


def all_queries():
    """Import every query module and return ``(queries, oracle_sql)``."""
    import importlib

    from docframe.plans import registry

    for part in MODULES:
        importlib.import_module(f"docframe.plans.{part}")
    return registry.QUERIES, registry.ORACLES


MODULES = ("queries_pages", "queries_text", "queries_series", "queries_outline", "queries_jobs", "queries_grid", "queries_sources")
