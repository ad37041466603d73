"""Where queries are registered: a name, a callable (spark, folder) and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.sources.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader ``t`` (``t("orders")`` is a DataFrame) under its own name or ``name``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        key = name or f.__name__
        run.__name__, run.__doc__ = key, f.__doc__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = sql
        return f

    return add
