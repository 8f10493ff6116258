"""All registered queries with the SQL they equal, from the modules of ``plans``."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timelines", "graph_queries", "trend_queries", "place_queries", "text_queries", "misc_queries", "document_queries", "payload_queries", "stream_queries", "training_queries", "dataset_queries", "record_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"tideline.plans.{name}"), attribute)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
