"""Joins and windows along time: as-of, bracketed interpolation, antecedent features, hours since an event, regular spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Seconds that a window of an as-of join without a tolerance spans.
BLOCK_S = 8 * 86_400


def asof(left: DataFrame, right: DataFrame, on: list[str], time: str, columns: list[str], tolerance_s: int | None = None, direction: str = "nearest", order: str | None = None, prefix: str = "") -> DataFrame:
    """Every row of ``left`` with ``columns`` of the row of ``right`` nearest in ``time`` (or the last before, the first after) and ``lag_h``, source minus query.

    Outside the tolerance (inclusive) all is null. On equal distance the earlier row counts; of rows at the same time the last by ``order``
    looking back, the first looking ahead. With a tolerance the right rows are laid into the three time buckets from which they
    can be reached, so that no task holds more of a key than three tolerances' worth and no pairs are made; without one, rows share a
    window per bucket of ``BLOCK_S``, and what comes before and after a bucket is carried to it over one row per bucket. Rows of either side with a null key or time match nothing.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    keys = [f"__k{i}" for i in range(len(on))]
    key_cols = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    r = right.select(*key_cols, us.alias("__t"), (F.col(order) if order else F.lit(0)).alias("__o"), *(F.col(c).alias(f"__r_{c}") for c in columns)).dropna(subset=[*keys, "__t"])
    own = left.select(F.struct(*left.columns).alias("__left"), *key_cols, us.alias("__t"))
    width = BLOCK_S * 1_000_000 if tolerance_s is None else max(1, tolerance_s * 1_000_000)
    bucket = F.expr(f"(__t - pmod(__t, {width}L)) div {width}L")
    own = own.withColumn("__b", bucket)
    r = r.withColumn("__b", bucket if tolerance_s is None else F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    union = own.withColumn("__side", F.lit(1)).unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__b")
    is_right = F.col("__side") == 0
    source = F.struct("__t", *(F.col(f"__r_{c}") for c in columns))
    back = F.last(F.when(is_right, source), ignorenulls=True).over(w.orderBy("__t", "__side", "__o").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(is_right, source), ignorenulls=True).over(w.orderBy("__t", F.desc("__side"), "__o").rowsBetween(1, Window.unboundedFollowing))
    found = union.withColumns({"__back": back, "__ahead": ahead}).where("__side = 1")
    if tolerance_s is None:
        at = F.when(is_right, F.struct("__t", "__o"))
        ends = union.groupBy(*keys, "__b").agg(F.max_by(source, at).alias("__last"), F.min_by(source, at).alias("__first"))
        over = Window.partitionBy(*keys).orderBy("__b")
        ends = ends.select(
            *(F.col(k).alias(f"__e{i}") for i, k in enumerate([*keys, "__b"])),
            F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"), F.first("__first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__later"),
        )
        same = [found[k].eqNullSafe(ends[f"__e{i}"]) for i, k in enumerate([*keys, "__b"])]
        found = found.join(ends, same, "left").withColumns({"__back": F.coalesce("__back", "__earlier"), "__ahead": F.coalesce("__ahead", "__later")})
    union = found
    to_back, to_ahead = F.col("__t") - F.col("__back.__t"), F.col("__ahead.__t") - F.col("__t")
    if direction == "backward":
        chosen = F.col("__back")
    elif direction == "forward":
        chosen = F.col("__ahead")
    else:
        chosen = F.when(F.col("__ahead").isNull() | (to_back <= to_ahead), F.col("__back")).otherwise(F.col("__ahead"))
    union = union.withColumn("__c", F.when(F.col("__t").isNotNull(), chosen))
    if tolerance_s is not None:
        union = union.withColumn("__c", F.when(F.abs(F.col("__c.__t") - F.col("__t")) <= tolerance_s * 1_000_000, F.col("__c")))
    return union.select("__left.*", *(F.col(f"__c.__r_{c}").alias(prefix + c) for c in columns), ((F.col("__c.__t") - F.col("__t")) / HOUR_US).alias(prefix + "lag_h"))


def nearest_valid(queries: DataFrame, scenes: DataFrame, on: list[str], time: str, value: str, valid: str, tolerance_s: int, min_valid: float = 0.5) -> DataFrame:
    """Every row of ``queries`` (a pixel and a time) with ``value`` of the nearest scene in which that pixel is valid, and ``lag_h``.

    Scenes in which the pixel has no value or is valid to less than ``min_valid`` are passed over, whatever their distance; see ``asof``.
    """
    seen = scenes.where(F.col(value).isNotNull() & (F.col(valid) >= min_valid))
    return asof(queries, seen, on, time, [value], tolerance_s, "nearest", value)


def value_at(queries: DataFrame, series: DataFrame, on: list[str], time: str, value: str, max_gap_s: int | None, name: str) -> DataFrame:
    """``queries`` with the linear interpolation of ``value`` at their time; null outside the record and where the neighbours are more than ``max_gap_s`` apart; an exact hit is the value itself."""
    known = series.where(F.col(value).isNotNull()).select(*on, time, F.col(value).alias("__v"), F.unix_micros(F.col(time).cast("timestamp")).alias("__at"))
    before = asof(queries, known, on, time, ["__v", "__at"], max_gap_s, "backward", "__v", "__b").drop("__blag_h")
    both = asof(before, known, on, time, ["__v", "__at"], max_gap_s, "forward", "__v", "__f").drop("__flag_h")
    t = F.unix_micros(F.col(time).cast("timestamp"))
    gap = F.col("__f__at") - F.col("__b__at")
    weight = (t - F.col("__b__at")) / gap
    ok = F.lit(True) if max_gap_s is None else gap <= max_gap_s * 1_000_000
    v = F.when(F.col("__b__at") == t, F.col("__b__v")).when(ok, F.col("__b__v") + weight * (F.col("__f__v") - F.col("__b__v")))
    return both.withColumn(name, v).drop("__b__v", "__b__at", "__f__v", "__f__at")


def changes(queries: DataFrame, series: DataFrame, on: list[str], time: str, value: str, hours: list[int], name: str) -> DataFrame:
    """``queries`` with ``<name>_at`` and, for every number of hours, ``<name>_d<hours>h``: the value then minus the value so long before, both interpolated; null where either is unknown."""
    out = value_at(queries, series, on, time, value, None, f"{name}_at")
    own = queries.schema[time].dataType
    for h in hours:
        shifted = out.withColumn("__now", F.col(time)).withColumn(time, (F.col(time).cast("timestamp") - F.expr(f"INTERVAL {h} HOURS")).cast(own))
        before = value_at(shifted, series, on, time, value, None, "__before").drop(time).withColumnRenamed("__now", time)
        out = before.withColumn(f"{name}_d{h}h", F.col(f"{name}_at") - F.col("__before")).drop("__before")
    return out


def trailing(value: Column, on: list[str], time: str, seconds: int, how=F.avg) -> Column:
    """An aggregate over (t - seconds, t]: left-open, hence one microsecond less than Spark's closed range."""
    w = Window.partitionBy(*on).orderBy(F.unix_micros(F.col(time).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return how(value).over(w)


def window_features(series: DataFrame, on: list[str], time: str, value: str, hours: list[int], min_frac: float = 0.75) -> DataFrame:
    """Hourly series with ``{value}_mean{h}h``, the trailing mean, null unless at least ``min_frac`` of the hours have a value."""
    cols = {}
    for h in hours:
        n = trailing(F.col(value), on, time, h * 3600, F.count)
        cols[f"{value}_mean{h}h"] = F.when(n >= min_frac * h, trailing(F.col(value), on, time, h * 3600, F.avg))
    return series.withColumns(cols)


def hours_since(rows: DataFrame, on: list[str], time: str, event: Column) -> Column:
    """Hours since the last row (this one included) at which ``event`` held; null before the first."""
    t = F.col(time).cast("timestamp")
    w = Window.partitionBy(*on).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    return (F.unix_micros(t) - F.unix_micros(F.max(F.when(event, t)).over(w))) / HOUR_US


def spine(ends: DataFrame, on: list[str], first: str, last: str, step: str, name: str) -> DataFrame:
    """Every step from ``first`` to ``last`` of each key."""
    return ends.select(*on, F.explode(F.sequence(F.col(first), F.col(last), F.expr(f"INTERVAL {step}"))).alias(name))


def running_median_outliers(series: DataFrame, on: list[str], time: str, rec_id: str, value: str, hours: int = 25, k: float = 5.0, min_abs: float = 1.0) -> DataFrame:
    """``series`` with ``outlier``: the deviation from the centred running median exceeds ``min_abs`` and k robust standard deviations.

    The window is (t - h/2, t + h/2]; as framed medians do not exist, rows are laid into the buckets from which they are reached.
    """
    half = hours * 1800 * 1_000_000
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = series.select(*on, F.col(rec_id).alias("__id"), t.alias("__t"), F.col(value).alias("__v"))
    bucket = F.expr(f"(__t - pmod(__t, {half}L)) div {half}L")
    reach = rows.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).select(*on, "__b", F.col("__t").alias("__u"), F.col("__v").alias("__w"))
    near = rows.withColumn("__b", bucket).join(reach, [*on, "__b"]).where((F.col("__u") > F.col("__t") - half) & (F.col("__u") <= F.col("__t") + half))
    med = near.groupBy(*on, "__id", "__v").agg(F.median("__w").alias("__m")).withColumn("__d", F.col("__v") - F.col("__m"))
    scale = med.groupBy(*on).agg((1.4826 * F.median(F.abs("__d"))).alias("__s"))
    flags = med.join(scale, on).select(F.col("__id").alias(rec_id), "__m", ((F.abs("__d") > min_abs) & (F.abs("__d") > k * F.col("__s"))).alias("outlier"))
    return series.join(flags, rec_id, "left").withColumnRenamed("__m", "running_median")
