"""Registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidefold.plans.views import Tables, reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Registers a function of a table reader under its name."""

    def put(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, path: f(reader(spark, path))
        if sql:
            ORACLE[key] = sql
        return f

    return put
