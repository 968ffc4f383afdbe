"""Irregular readings onto a regular daily grid: bucket, complete, carry forward within a maximum gap, mark what stays missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quagmark.nulls import present
from quagmark.operators.trailing import HOURS, calendar_of


def latest_days(df: DataFrame, series: list[str], day: str, version: str, fields: list[str]) -> DataFrame:
    """Per series and day the row of the latest ``version`` (a null version is the earliest; on a tie the greatest fields count)."""
    best = F.max(F.struct(F.coalesce(F.unix_micros(version), F.lit(-(1 << 62))).alias("__version"), *fields)).alias("__best")
    return present(df, *series, day).groupBy(*series, day).agg(best).select(*series, day, *(F.col(f"__best.{f}").alias(f) for f in fields))


def days_with(df: DataFrame, series: list[str], time: str, version: str, holds: Column) -> DataFrame:
    """The series and days of which at least one hour's latest row fulfils ``holds``.

    Version and truth are packed into one number per hour slot, so that a hash aggregate of 24 longs does it in one shuffle, in
    which copies are combined beforehand. On equal versions a row that holds counts.
    """
    packed = F.coalesce(F.unix_micros(version), F.lit(0)) * 2 + F.coalesce(holds, F.lit(False)).cast("int")
    slim = present(df, *series, time).select(*series, F.to_date(time).alias("day"), F.hour(time).alias("__hour"), packed.alias("__p"))
    slots = slim.groupBy(*series, "day").agg(*(F.max(F.when(F.col("__hour") == h, F.col("__p"))).alias(f"__h{h}") for h in range(HOURS)))
    any_holds = F.greatest(*(F.coalesce(F.pmod(F.col(f"__h{h}"), F.lit(2)), F.lit(0)) for h in range(HOURS)))
    return slots.where(any_holds == 1).select(*series, "day")


def daily_grid(readings: DataFrame, series: list[str], day: str, version: str, value: str, fields: list[str], usable: Column, refill: DataFrame, max_gap: int) -> DataFrame:
    """The full daily series: (series, day, value, filled, mark), one row for every day from a series' first to its last.

    mark is ``ok`` where the latest version of the day is ``usable`` (a condition over value and fields; null counts as no),
    else ``refill`` where ``refill`` (series, day) has the day, else ``gap``. ``filled`` is the last usable value if it is at
    most ``max_gap`` days old, else null. The windows run over daily rows, so a series never holds more rows than the calendar has
    days. Rows with a null series or day are left out; repeated rows collapse; an empty table gives an empty result.
    """
    latest = latest_days(readings, series, day, version, [value, *fields]).withColumn("__ok", F.coalesce(usable, F.lit(False)))
    spine = calendar_of(present(readings, *series, day), series, day)
    full = spine.join(latest, [*series, day], "left").withColumn("__ok", F.coalesce("__ok", F.lit(False)))
    full = full.withColumn("__v", F.when(F.col("__ok"), F.col(value)))
    w = Window.partitionBy(*series).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"__last": F.last("__v", ignorenulls=True).over(w), "__last_day": F.last(F.when(F.col("__ok"), F.col(day)), ignorenulls=True).over(w)})
    can = refill.select(*series, F.col("day").alias(day), F.lit(True).alias("__refill")).distinct()
    full = full.join(can, [*series, day], "left")
    return full.select(
        *series, F.col(day).alias("day"), F.col("__v").alias("value"), F.when(F.datediff(day, "__last_day") <= max_gap, F.col("__last")).alias("filled"),
        F.when(F.col("__ok"), "ok").when(F.coalesce("__refill", F.lit(False)), "refill").otherwise("gap").alias("mark"),
    )
