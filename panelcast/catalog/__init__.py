"""The registered queries, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from panelcast.catalog.registry import ORACLES, QUERIES

MODULES = ("panel", "io", "cleaning", "windows", "reports", "forecasts", "uploads", "alerts", "landing", "growing", "learning")

for _name in MODULES:
    import_module(f"panelcast.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
