"""Registered queries: a name, a Spark plan over the given tables, and its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` answers the same question on the same tables.

    Registered plans read wall-clock columns, so they run in UTC.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def with_tables(names: str, select: str) -> str:
    """SQL text with the named shared subqueries in front, in the order given."""
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split())
    return f"WITH {parts}\n{select}"
