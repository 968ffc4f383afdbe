"""A book of named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enters a function, under its name, with the SQL that gives the same rows."""

    def enter(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return enter


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every DOUBLE column rounded, so that the order of summation does not show."""
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


def r6(c: Column) -> Column:
    return F.round(c, 6)
