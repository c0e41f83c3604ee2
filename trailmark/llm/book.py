"""The queries of this folder: a name, a callable of (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if QUERIES.setdefault(name, fn) is not fn:
            raise ValueError(f"query registered twice: {name}")
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
