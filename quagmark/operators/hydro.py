"""Water and weather: evaporation, antecedent precipitation, buckets, memory, soil motion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quagmark.operators.stats import corr
from quagmark.operators.temporal import asof

# Constants of the published formulas.
SOLAR_CONSTANT = 0.0820  # MJ per m2 and minute (FAO-56)
RAIN_CLASSES = [(50, "extremely dry"), (75, "very dry"), (90, "dry"), (110, "normal"), (125, "wet"), (150, "very wet")]


def day_length_h(doy: Column, lat: Column) -> Column:
    """Hours of daylight by declination."""
    decl = 0.409 * F.sin(2 * math.pi * doy / 365 - 1.39)
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(F.radians(lat)) * F.tan(decl)))
    return 24 / math.pi * F.acos(x)


def hamon_pet(temp_c: Column, doy: Column, lat: Column) -> Column:
    """Hamon's potential evapotranspiration in mm a day; 0 in frost."""
    vapour = 0.6108 * F.exp(17.27 * temp_c / (temp_c + 237.3))
    return F.when(temp_c > 0, 0.1651 * (day_length_h(doy, lat) / 12) * (216.7 * vapour * 10 / (temp_c + 273.3))).otherwise(F.when(temp_c.isNotNull(), 0.0))


def extraterrestrial_radiation(doy: Column, lat: Column) -> Column:
    """FAO-56 Ra in MJ per m2 and day."""
    phi, decl = F.radians(lat), 0.409 * F.sin(2 * math.pi * doy / 365 - 1.39)
    inverse_distance = 1 + 0.033 * F.cos(2 * math.pi * doy / 365)
    ws = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(decl))))
    return 24 * 60 / math.pi * SOLAR_CONSTANT * inverse_distance * (ws * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(ws))


def hargreaves_et0(tmax: Column, tmin: Column, doy: Column, lat: Column) -> Column:
    return 0.0023 * 0.408 * extraterrestrial_radiation(doy, lat) * ((tmax + tmin) / 2 + 17.8) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0)))


def dew_point_c(temp_c: Column, rh: Column) -> Column:
    """Magnus formula with Sonntag's coefficients; humidity is held within 0.001 to 100 %."""
    g = F.ln(F.least(F.greatest(rh, F.lit(1e-3)), F.lit(100.0)) / 100) + 17.62 * temp_c / (243.12 + temp_c)
    return 243.12 * g / (17.62 - g)


def rain_class(percent: Column) -> Column:
    """Class of a period's rain by percent of the normal."""
    out = F.lit("extremely wet")
    for upper, name in reversed(RAIN_CLASSES):
        out = F.when(percent < upper, name).otherwise(out)
    return F.when(percent.isNotNull(), out)


def recursion(df: DataFrame, on: list[str], day: str, value: str, decay: float, gain: float, name: str, skip_first: bool = False) -> DataFrame:
    """``df`` with a_i = decay * a_(i-1) + gain * x_i over each key's days in order (null counts as 0); 0 < decay <= 1.

    Days are cut into blocks. Inside a block a_i is a running sum of x_j / decay^j, scaled back (a block is short enough for the
    powers); a block's end is carried to later blocks by a window over one row per block, as far as it shows in a double.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be above 0 and at most 1")
    size = 4096 if decay == 1 else max(1, min(4096, int(230 / -math.log(decay))))
    w = Window.partitionBy(*on).orderBy(day)
    x = F.coalesce(F.col(value), F.lit(0.0))
    d = df.withColumn("__i", F.row_number().over(w) - 1)
    d = d.withColumns({"__b": F.expr(f"__i div {size}"), "__r": F.col("__i") % size, "__x": F.when(F.lit(skip_first) & (F.col("__i") == 0), 0.0).otherwise(x)})
    power = lambda k: F.pow(F.lit(float(decay)), k)
    inside = F.sum(F.col("__x") * power(-F.col("__r"))).over(Window.partitionBy(*on, "__b").orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__own", power(F.col("__r")) * inside)
    ends = d.groupBy(*on, "__b").agg(F.max_by("__own", "__r").alias("__e"))
    earlier = Window.partitionBy(*on).orderBy("__b")
    if decay == 1:
        carry = F.coalesce(F.sum("__e").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    else:
        blocks = max(1, math.ceil(math.log(1e-17) / (size * math.log(decay))))
        carry = F.aggregate(F.collect_list("__e").over(earlier.rowsBetween(-blocks, -1)), F.lit(0.0), lambda a, v: a * decay**size + v)
    out = d.join(ends.select(*on, "__b", carry.alias("__c")), [*on, "__b"])
    return out.withColumn(name, gain * (F.col("__own") + power(F.col("__r") + 1) * F.col("__c"))).drop("__i", "__b", "__r", "__x", "__own", "__c")


def antecedent_precipitation(df: DataFrame, on: list[str], day: str, rain: str, k: float = 0.9) -> DataFrame:
    """The antecedent precipitation index API_i = k API_(i-1) + P_i, starting from 0 on the first day."""
    return recursion(df, on, day, rain, k, 1.0, "api", skip_first=True)


def exponential_memory(df: DataFrame, on: list[str], day: str, value: str, tau_days: float) -> DataFrame:
    """Exponentially weighted past with e-folding time ``tau_days``."""
    decay = math.exp(-1 / tau_days)
    return recursion(df, on, day, value, decay, 1 - decay, "memory")


def bucket(df: DataFrame, on: list[str], day: str, rain: str, pet: str, start: float, gain: float, loss: float, drain: float, floor: float | None = None) -> DataFrame:
    """Levels of a linear bucket w += gain rain - loss pet - drain w, never below ``floor``; a sequential model, folded over each key's sorted days."""
    item = F.struct(F.col(day).alias("d"), F.coalesce(F.col(rain), F.lit(0.0)).alias("r"), F.coalesce(F.col(pet), F.lit(0.0)).alias("e"))
    days = df.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("__s"))
    zero = F.struct(F.lit(float(start)).alias("w"), F.array().cast("array<double>").alias("out"))

    def step(acc, x):
        w = acc["w"] + gain * x["r"] - loss * x["e"] - drain * acc["w"]
        w = F.greatest(w, F.lit(float(floor))) if floor is not None else w
        return F.struct(w.alias("w"), F.concat(acc["out"], F.array(w)).alias("out"))

    folded = days.select(*on, F.arrays_zip(F.col("__s").alias("s"), F.aggregate("__s", zero, step)["out"].alias("w")).alias("z"))
    return folded.select(*on, F.explode("z").alias("z")).select(*on, F.col("z.s.d").alias(day), F.col("z.w").alias("level"))


def window_sum(value: Column, on: list[str], day: str, tau: int) -> Column:
    """Sum over the trailing ``tau`` rows; null until there are as many."""
    w = Window.partitionBy(*on).orderBy(day)
    return F.when(F.row_number().over(w) >= tau, F.sum(F.coalesce(value, F.lit(0.0))).over(w.rowsBetween(-(tau - 1), 0)))


def reversible(df: DataFrame, on: list[str], day: str, rain: str, pet: str, x_p: float, x_e: float, tau: int) -> DataFrame:
    """The reversible motion x_p sum(P) - x_e sum(E) over tau days, and the number of days so far on which it was not positive."""
    d = df.withColumn("reversible", x_p * window_sum(F.col(rain), on, day, tau) - x_e * window_sum(F.col(pet), on, day, tau))
    w = Window.partitionBy(*on).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("dry_days", F.sum(F.when(F.col("reversible") <= 0, 1).otherwise(0)).over(w))


def freeze_flags(df: DataFrame, on: list[str], time: str, temp: str, days: int = 5) -> DataFrame:
    """``df`` with ``frozen``: the mean of the trailing days is below 0."""
    from quagmark.operators.temporal import trailing

    return df.withColumn("frozen", trailing(F.col(temp), on, time, days * 86400) < 0)


def lag_correlation(series: DataFrame, driver: DataFrame, day: str, value: str, x: str, lags: list[int], min_n: int = 6) -> DataFrame:
    """r of the series with the driver so many days before, per lag, and whether it is the strongest."""
    a = series.select(F.col(day).alias("__d"), F.col(value).alias("__y")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("__e", F.date_sub("__d", F.col("lag")))
    j = a.join(driver.select(F.col(day).alias("__e"), F.col(x).alias("__x")), "__e").where("__x IS NOT NULL AND __y IS NOT NULL")
    g = j.groupBy("lag").agg(F.count("*").alias("n"), corr("__x", "__y").alias("r")).where(F.col("n") >= min_n)
    best = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.abs("r"), 9)), "lag")) == 1
    return g.withColumn("best", best)


#: Fixed value: millimetres of zenith delay per millimetre of precipitable water.
DELAY_PER_WATER = 6.2


def pair_wet_delays(pairs: DataFrame, water: DataFrame, on: list[str], t1: str, t2: str, time: str, value: str, hour: float, tolerance_h: int = 12) -> DataFrame:
    """``pairs`` (dates) with ``delay_mm``, the change of the zenith wet delay between both dates at ``hour`` UTC, from the water column nearest in time; null if an end has none within the tolerance."""
    out = pairs
    for end, name in ((t1, "__w1"), (t2, "__w2")):
        at = out.withColumn(time, (F.unix_seconds(F.col(end).cast("timestamp")) + int(hour * 3600)).cast("timestamp"))
        out = asof(at, water, on, time, [value], tolerance_h * 3600).drop("lag_h", time).withColumnRenamed(value, name)
    return out.withColumn("delay_mm", DELAY_PER_WATER * (F.col("__w2") - F.col("__w1"))).drop("__w1", "__w2")
