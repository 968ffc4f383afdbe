"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quagmark.nulls import nan_to_null


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table with NaN as NULL and its zoneless timestamps as UTC timestamps."""
    df = nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))
    return df.select(*(F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema))
