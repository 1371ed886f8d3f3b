"""Import every query module once and hand out the registry."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLE, PLANS

MODULES = ["checks_core", "checks_panel", "checks_spatial", "checks_labels", "checks_graph", "checks_tables"]


def load():
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return PLANS, ORACLE
