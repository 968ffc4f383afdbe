"""Totals over trailing periods by spreading each day onto the dates that it influences.

A day's total counts in every date up to a period's length later; it is exploded onto those dates, summed there by series and
date (combined before the shuffle), and calendar rows supply the zeros. Days whose total is zero influence nothing and are not
exploded. Amounts are kept as whole millionths, so that sums do not depend on the order in which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quagmark.nulls import present

UNIT = 1_000_000
HOURS = 24


def amount(c: Column | str) -> Column:
    """A number as whole millionths; null for null."""
    return F.round((F.col(c) if isinstance(c, str) else c) * UNIT).cast("long")


def latest_hours(df: DataFrame, series: list[str], time: str, version: str, tie: str, fields: list[Column]) -> DataFrame:
    """One row per series and day with ``hours``, an array of 24 structs: per hour the row of the latest ``version`` (null if there is none).

    One aggregate with a slot per hour, so copies of an hour, however many, are combined before the shuffle and a day never
    holds more than 24 rows. On equal versions the row with the greatest ``tie`` counts; a null version is the earliest. Rows
    with a null series or time belong nowhere and are left out. Times are taken to lie on whole hours; another time counts in its hour.
    """
    row = F.struct(F.coalesce(F.unix_micros(version), F.lit(-(1 << 62))).alias("__version"), F.col(tie), *fields)
    slim = present(df, *series, time).select(*series, F.to_date(time).alias("day"), F.hour(time).alias("__hour"), row.alias("__row"))
    slots = [F.max(F.when(F.col("__hour") == h, F.col("__row"))).alias(f"__h{h}") for h in range(HOURS)]
    return slim.groupBy(*series, "day").agg(*slots).select(*series, "day", F.array(*(F.col(f"__h{h}") for h in range(HOURS))).alias("hours"))


def trailing_totals(daily: DataFrame, series: list[str], day: str, amounts: list[str], periods: list[int], calendar: DataFrame | None = None) -> DataFrame:
    """Per series and day the total of each of ``amounts`` over the trailing ``periods`` (in days, the day itself included).

    ``daily`` has one row per series and day with whole amounts (see ``amount``); null amounts count as zero. ``calendar`` has the
    series and days to answer for; by default every day from a series' first to its last. Columns come out as
    ``{amount}_{period}d``, in whole amounts, 0 where nothing happened. Rows with a null series or day are left out; an empty
    table gives an empty result.
    """
    daily = present(daily, *series, day).select(*series, F.col(day).alias("__day"), *(F.coalesce(F.col(a), F.lit(0)).alias(a) for a in amounts))
    if calendar is None:
        calendar = calendar_of(daily, series, "__day").withColumnRenamed("__day", day)
    active = daily.where(" OR ".join(f"{a} <> 0" for a in amounts))
    spread = active.withColumn("__off", F.explode(F.sequence(F.lit(0), F.lit(max(periods) - 1)))).withColumn(day, F.date_add("__day", F.col("__off")))
    sums = spread.groupBy(*series, day).agg(*(F.sum(F.when(F.col("__off") < p, F.col(a)).otherwise(0)).alias(f"{a}_{p}d") for a in amounts for p in periods))
    return calendar.join(sums, [*series, day], "left").na.fill(0, [f"{a}_{p}d" for a in amounts for p in periods])


def calendar_of(df: DataFrame, series: list[str], day: str) -> DataFrame:
    """Every day from a series' first to its last."""
    ends = df.groupBy(*series).agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
    return ends.select(*series, F.explode(F.sequence("__first", "__last")).alias(day))


def trailing_hours(days: DataFrame, series: list[str], value: str, flag: str, periods: list[int], flag_days: int) -> DataFrame:
    """Per series and hour that has a row: ``hour`` (the row), the total of ``value`` over the trailing ``periods`` of whole days that end
    with that hour, and whether ``flag`` holds anywhere in the trailing ``flag_days``.

    ``days`` comes from ``latest_hours``; ``value`` is a whole amount in its rows. The last 24k hours up to hour h of day D are the k-1
    days before D, the hours up to h of D, and the hours after h of day D-k: whole days are spread as totals, the two ends as arrays
    by hour, onto the dates that they influence.
    """
    zero = F.lit(0).cast("long")
    amounts = F.transform("hours", lambda x: F.coalesce(x[value], zero))
    flagged = F.transform(F.filter(F.transform("hours", lambda x, i: F.when(F.coalesce(x[flag], F.lit(False)), i)), lambda i: i.isNotNull()), lambda i: i)
    rich = days.withColumns({"__v": amounts, "__f": flagged}).withColumn("__total", F.aggregate("__v", zero, lambda a, x: a + x))
    upto = F.transform(F.sequence(F.lit(1), F.lit(HOURS)), lambda n: F.aggregate(F.slice(F.col("__v"), F.lit(1), n), zero, lambda a, x: a + x))
    rich = rich.withColumn("__upto", F.when(F.col("__total") != 0, upto)).withColumn("__last", F.coalesce(F.array_max("__f"), F.lit(-1)))

    active = rich.where("__total <> 0 OR __last >= 0").select(*series, F.col("day").alias("__day"), "__total", "__last", F.transform("__upto", lambda x: F.col("__total") - x).alias("__after"))
    off = F.col("__off")
    spread = active.withColumn("__off", F.explode(F.sequence(F.lit(1), F.lit(max([*periods, flag_days]))))).withColumn("day", F.date_add("__day", off))
    spread = spread.withColumn("__after", F.when(off.isin(periods), F.col("__after")))
    reached = spread.groupBy(*series, "day").agg(
        *(F.sum(F.when(off < p, F.col("__total")).otherwise(0)).alias(f"__mid{p}") for p in periods),
        *(F.max(F.when(off == p, F.col("__after"))).alias(f"__end{p}") for p in periods),
        F.max((off < flag_days) & (F.col("__last") >= 0)).alias("__flag_mid"),
        F.max(F.when(off == flag_days, F.col("__last"))).alias("__flag_end"),
    )
    whole = rich.select(*series, "day", "hours", "__upto", F.array_min("__f").alias("__first")).join(reached, [*series, "day"], "left")
    or_empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<bigint>"))
    each = whole.select(
        *series, *(f"__mid{p}" for p in periods), "__first", "__flag_mid", "__flag_end",
        F.posexplode(F.arrays_zip(F.col("hours").alias("hour"), or_empty("__upto").alias("upto"), *(or_empty(f"__end{p}").alias(f"end{p}") for p in periods))).alias("__h", "x"),
    ).where("x.hour IS NOT NULL")
    or0 = lambda c: F.coalesce(F.col(c), zero)
    return each.select(
        *series, "x.hour",
        *((or0("x.upto") + or0(f"__mid{p}") + or0(f"x.end{p}")).alias(f"total_{p}d") for p in periods),
        (F.coalesce(F.col("__first") <= F.col("__h"), F.lit(False)) | F.coalesce("__flag_mid", F.lit(False)) | F.coalesce(F.col("__flag_end") > F.col("__h"), F.lit(False))).alias("flagged"),
    )
