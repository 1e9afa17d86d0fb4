"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _load() -> None:
    from . import account_queries, blob_queries, causal_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from .registry import ORACLES

    _load()
    return dict(ORACLES)
