"""All queries and their SQL, gathered from the query modules."""

from __future__ import annotations

from importlib import import_module

from hyperloom.plans import registry, rounding

MODULES = ("text_queries", "record_queries", "graph_queries", "metric_queries", "ordered_queries", "file_queries")


def _load() -> None:
    for m in MODULES:
        import_module(f"hyperloom.plans.{m}")


def queries() -> dict:
    """The queries as they are."""
    _load()
    return dict(registry.QUERIES)


def compared_queries() -> dict:
    """The same with computed doubles to six places, to be compared with ``oracle_sql``."""
    _load()
    return {n: rounding.rounded(n, f) for n, f in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL with computed doubles to six places."""
    _load()
    return {n: rounding.rounded_sql(n, s) for n, s in registry.SQL.items()}
