"""Registered queries: name -> Spark callable ``(spark, sf_dir) -> DataFrame``
and, where one can be written, an independent DuckDB SQL oracle.

Queries read the driver tables (or views Spark derives from them) whole.
Double outputs are rounded to 6 decimals on both sides so that the
order-insensitive comparison does not depend on summation order.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = [
    "foldwise.plans.q_folds",
    "foldwise.plans.q_scores",
    "foldwise.plans.q_ensemble",
    "foldwise.plans.q_monitor",
    "foldwise.plans.q_pooling",
    "foldwise.plans.q_tokens",
    "foldwise.plans.q_stack",
    "foldwise.plans.q_io",
]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for m in _MODULES:
        importlib.import_module(m)
    return dict(QUERIES), dict(ORACLE)
