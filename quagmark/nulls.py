"""Missing values: the engine knows NULL only, so NaN is turned into NULL where data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(c: Column | str) -> Column:
    """The number, or NULL where it is NaN."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every FLOAT and DOUBLE column without NaN."""
    kinds = (T.FloatType, T.DoubleType)
    return df.select(*(known(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema))


def present(df: DataFrame, *columns: str) -> DataFrame:
    """The rows in which none of the columns is null.

    One IS NOT NULL per column, which the optimiser merges with those that it infers from joins, so that branches of a plan stay alike and share their exchange.
    """
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df
