"""Pairs each query with its oracle SQL and puts both results into one comparable form.

Doubles are rounded to six decimals and to single precision on both sides, so
that a different summation order cannot change a result. A tiny shift before the
rounding keeps short decimals, such as means of prices, off the rounding ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHIFT = 3e-8

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_FORMS: dict[str, tuple[str, str, str | None]] = {}


def comparable(name: str) -> Column:
    rounded = F.round(F.col(name) + SHIFT, 6).cast("float").cast("double")
    # A negative zero would differ from zero in a value hash.
    return F.when(rounded == 0.0, F.lit(0.0)).otherwise(rounded).alias(name)


def comparable_sql(name: str) -> str:
    rounded = f'CAST(CAST(round("{name}" + CAST({SHIFT} AS DOUBLE), 6) AS REAL) AS DOUBLE)'
    return f'CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS "{name}"'


def register(name: str, plain: str, doubles: str = "", sql: str | None = None):
    """Register a query returning ``plain`` columns unchanged and ``doubles`` rounded."""
    plain_names, double_names = plain.split(), doubles.split()
    _FORMS[name] = (plain, doubles, sql)

    def decorate(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, sf_dir).select(*plain_names, *map(comparable, double_names))

        QUERIES[name] = run
        if sql is not None:
            columns = [f'"{c}"' for c in plain_names] + [comparable_sql(c) for c in double_names]
            ORACLES[name] = f"SELECT {', '.join(columns)} FROM ({sql}) AS oracle"
        return function

    return decorate


def register_like(name: str, known: str):
    """Register a query that has to return the rows of ``known`` by another plan."""
    return register(name, *_FORMS[known])
