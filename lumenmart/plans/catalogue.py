"""All registered queries."""

from __future__ import annotations

import importlib

from lumenmart.plans import registry

MODULES = ("market_queries", "decision_queries", "ownership_queries", "text_queries", "resolve_queries", "fact_queries", "ingest_queries", "serving_queries", "stream_queries", "view_queries", "run_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lumenmart.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
