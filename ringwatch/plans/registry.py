"""All registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

_MODULES = ["registered_points", "registered_joins", "registered_windows", "registered_models", "registered_streams"]


def _collect(kind: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(importlib.import_module(f"ringwatch.plans.{name}"), kind))
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
