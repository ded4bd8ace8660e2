"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tickerloom.catalog.views import with_views
from tickerloom.sources.derived import Research

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(research) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Research], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Research(spark, folder))
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn

    return register
