"""Registered checks: a Spark query per operator and, where SQL can say it, the same result in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6
#: Added before rounding in both engines. Means of prices often end in an exact 5 at the seventh digit, and there the last
#: bit of a sum, which depends on the order of the additions, would decide the rounding.
OFF_TIES = 0.0000000234


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL if there is one."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"check {name} is registered twice")
        QUERIES[name] = lambda spark, sf: rounded(query(spark, sf))
        if sql is not None:
            ORACLES[name] = sql.replace(f", {DIGITS})", f" + {OFF_TIES:.10f}, {DIGITS})")
        return query

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six digits, so that both engines may add in any order; the SQL rounds in the same way."""
    doubles = {
        f.name: F.round(F.col(f"`{f.name}`") + F.lit(OFF_TIES), DIGITS) for f in df.schema if isinstance(f.dataType, T.DoubleType)
    }
    return df.withColumns(doubles) if doubles else df


def r(expression: str, name: str | None = None) -> str:
    """SQL for a rounded double."""
    return f"round({expression}, {DIGITS}) AS {name or expression}"
