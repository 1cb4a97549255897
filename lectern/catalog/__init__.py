"""The query catalogue: one module per area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("parsing", "retrieval", "learning", "documents", "upkeep", "study")


def _areas():
    return [import_module(f"lectern.catalog.{name}").AREA for name in AREAS]


def all_queries() -> dict:
    return {name: fn for area in _areas() for name, fn in area.queries.items()}


def all_oracles() -> dict:
    return {name: sql for area in _areas() for name, sql in area.oracles.items()}
