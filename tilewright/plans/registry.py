"""Registered queries and their DuckDB SQL, gathered from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


from tilewright.plans import catalog_queries, durable_queries, geometry_queries, lookup_queries, placement_queries, pyramid_queries, session_queries, stain_queries, stream_queries, text_queries, view_queries  # noqa: E402, F401
