"""Registry of queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.sources.driver_tables import Tables
from tickloom.sources.sql_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``sql`` may use any view of ``sql_views``; the views it mentions are put in
    front of it as common table expressions.
    """

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql  # views are added by oracle_sql(), once every module has defined its own
        return fn

    return wrap
