"""Registered queries ``(spark, folder) -> DataFrame`` and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelake.catalog.sql_parts import compose
from passagelake.sources.tables import Lake

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a function of a ``Lake``; ``sql`` may mention any named SQL part."""

    def add(build: Callable[[Lake], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Lake(spark, folder))
        if sql:
            ORACLES[key] = compose(sql, extra)
        return build

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, so engines that add in a different order agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
