"""Queries over the test tables, grouped by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ("text_queries", "document_queries", "retrieval_queries", "index_queries", "matching_queries", "session_queries", "telemetry_queries",
         "metric_queries", "stream_queries", "contract_queries", "grid_queries")


def registry() -> dict:
    found: dict = {}
    for area in AREAS:
        found.update(import_module(f"{__name__}.{area}").QUERIES)
    return found
