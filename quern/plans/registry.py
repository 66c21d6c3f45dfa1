"""Registered queries: a name, a function of (spark, sf_dir), and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return add
