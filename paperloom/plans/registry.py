"""Registry of named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = (), extra: str = ""):
    """Register ``fn(spark, sf_dir)``; ``oracle`` reads ``views`` and further expressions ``extra``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(list(views), oracle, extra)
        return fn

    return register
