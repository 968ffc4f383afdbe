"""Field series: snow and wetness masks, well floors, filled stretches, sensor grids, membership in runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quagmark.operators.islands import ordered, run_id
from quagmark.operators.temporal import trailing


def plot_of(name: Column) -> Column:
    """The plot of a replicate's name: CL... is P5, CR... is P6, else what stands before the first underscore."""
    return F.when(name.startswith("CL"), "P5").when(name.startswith("CR"), "P6").otherwise(F.substring_index(name, "_", 1))


def frost_mask(df: DataFrame, on: list[str], time: str, temp: str, hours: int = 72) -> DataFrame:
    """``df`` with ``snow``: frost anywhere in the trailing hours; unknown temperatures count as frost."""
    cold = F.coalesce(F.col(temp) < 0, F.lit(True)).cast("int")
    return df.withColumn("snow", trailing(cold, on, time, hours * 3600, F.max) == 1)


def evidence_mask(df: DataFrame, on: list[str], time: str, thresholds: dict[str, float], hours: int = 72) -> DataFrame:
    """``df`` with ``snow``: any column above its threshold anywhere in the trailing hours; unknown is no evidence."""
    seen = F.lit(False)
    for c, limit in thresholds.items():
        seen = seen | F.coalesce(F.col(c) > limit, F.lit(False))
    return df.withColumn("snow", trailing(seen.cast("int"), on, time, hours * 3600, F.max) == 1)


def wetness(df: DataFrame, on: list[str], time: str, rh: str, rain: str, temp: str, rh_wet: float = 95.0, rain_hours: int = 3) -> DataFrame:
    """``df`` with ``wet`` (humid, or rain in the last hours) and ``frozen``; null where nothing is known."""
    rained = trailing(F.col(rain), on, time, rain_hours * 3600, F.sum)
    return df.withColumns({"wet": (F.col(rh) >= rh_wet) | (rained > 0), "frozen": F.col(temp) < 0})


def floor_plateaus(df: DataFrame, on: list[str], time: str, value: str, quantile: float = 0.02, tolerance: float = 1.5, min_hours: float = 120.0) -> DataFrame:
    """``df`` with ``censored``: stretches of at least ``min_hours`` within ``tolerance`` of the series' lowest values (a well's floor)."""
    floor = df.groupBy(*on).agg(F.percentile(value, quantile).alias("__f"))
    d = df.join(floor, on, "left").withColumn("__low", F.coalesce(F.col(value) <= F.col("__f") + tolerance, F.lit(False)))
    d = d.withColumn("__run", run_id(on, [time], F.lag("__low").over(ordered(on, time)) == F.col("__low")))
    own = Window.partitionBy(*on, "__run")
    t = F.unix_micros(F.col(time).cast("timestamp"))
    long_enough = F.max(t).over(own) - F.min(t).over(own) >= min_hours * 3.6e9
    return d.withColumn("censored", F.col("__low") & long_enough).drop("__f", "__low", "__run")


def filled_stretches(df: DataFrame, on: list[str], time: str, value: str, min_rows: int = 6, tolerance: float = 1e-3) -> DataFrame:
    """Stretches along a straight line in time that is not level: (first, last, n), n rows each of which lies on the line through its neighbours."""
    w = ordered(on, time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    share = F.try_divide(t - F.lag(t).over(w), F.lead(t).over(w) - F.lag(t).over(w))
    bend = F.abs(F.col(value) - before - share * (after - before))
    d = df.withColumn("__on", F.coalesce((bend <= tolerance) & (F.abs(after - before) > tolerance), F.lit(False)))
    d = d.withColumn("__run", run_id(on, [time], F.lag("__on").over(w) == F.col("__on"))).where("__on")
    return d.groupBy(*on, "__run").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).where(F.col("n") >= min_rows).drop("__run")


def grid_offsets(df: DataFrame, on: list[str], time: str, value: str, step: float = 0.1, min_days: int = 5) -> DataFrame:
    """Stretches of days that share the most frequent remainder of a sensor's step: (offset, first, last, n)."""
    r = F.round(F.pmod(F.round(F.col(value) / step, 6), F.lit(1.0)) * step, 4)
    r = F.when(F.abs(r - step) < 1e-9, 0.0).otherwise(r)
    daily = df.where(F.col(value).isNotNull()).groupBy(*on, F.to_date(time).alias("day"), r.alias("offset")).agg(F.count("*").alias("__n"))
    mode = daily.groupBy(*on, "day").agg(F.min(F.struct((-F.col("__n")).alias("m"), "offset")).alias("b")).select(*on, "day", F.col("b.offset").alias("offset"))
    w = ordered(on, "day")
    runs = mode.withColumn("__run", run_id(on, ["day"], F.lag("offset").over(w) == F.col("offset")))
    return runs.groupBy(*on, "__run", "offset").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).where(F.col("n") >= min_days).drop("__run")


def in_runs(rows: DataFrame, runs: DataFrame, on: list[str], time: str, first: str, last: str) -> DataFrame:
    """``rows`` with ``inside``: in a run of the same key. Runs of a key must not overlap: the last one that began decides, so a window does, no range join."""
    starts = runs.select(*on, F.col(first).alias(time), F.col(last).alias("__end"))
    union = rows.withColumn("__row", F.lit(1)).unionByName(starts.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    end = F.last("__end", ignorenulls=True).over(ordered(on, time, "__row").rowsBetween(Window.unboundedPreceding, 0))
    return union.withColumn("inside", F.coalesce(end >= F.col(time), F.lit(False))).where("__row = 1").drop("__row", "__end")


def difference_noise(df: DataFrame, on: list[str], time: str, value: str, clip: float, max_gap_s: int) -> DataFrame:
    """Per key the sample deviation of steps smaller than ``clip`` between rows at most ``max_gap_s`` apart."""
    w = ordered(on, time)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    d = df.where(F.col(value).isNotNull()).withColumns({"__d": F.col(value) - F.lag(value).over(w), "__g": t - F.lag(t).over(w)})
    return d.where((F.abs("__d") < clip) & (F.col("__g") <= max_gap_s * 1_000_000)).groupBy(*on).agg(F.stddev_samp("__d").alias("noise"), F.count("*").alias("n"))
