"""Every query's result stated a second time in SQL."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text", "documents", "retrieval", "index", "matching", "sessions", "telemetry", "grid")


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").ORACLES)
    return found
