"""Registration of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colsmith.session import table

MODULES = ("transforms", "safe", "sources", "profiles", "relations", "recommend", "models",
           "validation", "learning", "privacy", "evaluation", "streams")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(load)`` where ``load(table)`` reads a table of the data folder."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(lambda t: table(spark, folder, t))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
