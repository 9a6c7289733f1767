"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusgauge.plans import corpus, flows, model, runs

MODULES = (corpus, model, runs, flows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
