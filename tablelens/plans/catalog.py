"""Registry of named queries and their oracle SQL (used by ``__spark_entry__``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    exact_queries, forest_queries, model_data_queries, model_queries, profile_queries, scoring_queries, source_queries,
)

_MODULES = [profile_queries, model_data_queries, scoring_queries, model_queries, exact_queries, forest_queries,
            source_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.oracles())
    return out
