"""Query registry: a Spark query and, where SQL can say the same, its check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r(column, digits: int = 9):
    """Rounded double: sums in another order differ in the last digits."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column, whole numbers aside."""
    return df.select(
        *[r(f"`{n}`", digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def R(expression: str, digits: int = 9) -> str:
    """SQL text of :func:`r`."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
