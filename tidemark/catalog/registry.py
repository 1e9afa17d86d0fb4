"""Named queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Inputs
from .fixture_sql import with_fixtures

Build = Callable[[Inputs], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` may use any input of fixture_sql as a table."""

    def add(build: Build) -> Build:
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return build

    return add
