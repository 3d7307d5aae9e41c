"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import standalone, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(T)``, where ``T(name)`` reads a table of the given folder, under a name; ``sql`` is its twin."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda t: table(spark, sf_dir, t))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = standalone(sql)
        return fn

    return add


def scaled(x: Column | str, digits: int = 4) -> Column:
    """A decimal value as an exact integer number of units, so that sums don't depend on order; null where there is none."""
    x = F.col(x) if isinstance(x, str) else x
    units = x * F.lit(float(10**digits)) + F.lit(0.5)
    return F.when(F.abs(units) < float("inf"), F.floor(units).cast("long"))


def sql_scaled(x: str, digits: int = 4) -> str:
    return f"cast(floor({x} * 1e{digits} + 5e-1) as bigint)"


def sql_q(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 5e-1) / 1e{digits}"
