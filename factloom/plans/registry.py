"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["patterns", "stored", "indexes", "analytics", "keywords", "translation", "lookups", "files"]


def _gather(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
