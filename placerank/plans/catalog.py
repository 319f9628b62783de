"""Import every query module and expose the driver-facing dictionaries."""

from __future__ import annotations

from . import access, details, indicators, pillars, records, scores, texts  # noqa: F401  (registers queries)
from .registry import REGISTRY, oracle_text, spark_query

_MODULES_LOADED = True


def queries():
    return {name: spark_query(name) for name in REGISTRY}


def oracle_sql():
    out = {}
    for name in REGISTRY:
        sql = oracle_text(name)
        if sql is not None:
            out[name] = sql
    return out
