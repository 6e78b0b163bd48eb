"""Collects the queries of all plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "series_queries",
    "audit_queries",
    "stats_queries",
    "feature_queries",
    "model_queries",
    "anomaly_queries",
    "health_queries",
    "stream_queries",
    "table_queries",
]


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"sensorloom.plans.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
