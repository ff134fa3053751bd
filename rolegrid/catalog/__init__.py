"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matching", "identity", "review", "store", "pages", "prompts")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged.update(getattr(import_module(f"rolegrid.catalog.{name}"), attribute))
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
