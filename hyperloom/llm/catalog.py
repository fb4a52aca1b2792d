"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("splits", "near_duplicates", "target_sample", "varied_subset", "broken_pairs", "corpus_encoding", "container_packing", "stuffed_pages")


def _each():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _each() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _each() for k, v in m.SQL.items()}
