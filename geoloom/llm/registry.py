"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("url_filter", "mixing", "simhash", "language", "pieces", "token_counts", "lattice_lm", "token_store", "quality", "media")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"geoloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"geoloom.llm.{m}"), "ORACLE_SQL", {}).items()}
