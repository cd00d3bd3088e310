"""Registered queries over the given tables, each beside the SQL that states its result."""

from __future__ import annotations

from importlib import import_module

AREAS = ("sources", "filters", "profile", "charts", "diagnose", "clean", "engineer", "features", "evaluate", "models", "text")


def load() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
