"""Named queries over the star-schema tables, each next to the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.plans import listings, models, monitoring, prices, profile, sales, series, storage, watch

_MODULES = (sales, listings, prices, profile, series, models, monitoring, storage, watch)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
