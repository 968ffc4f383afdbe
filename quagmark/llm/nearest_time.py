"""Nearest record in time per entity, by tick expansion.

Every right record is exploded to the ticks that a left record within tolerance may fall in; per entity and tick only the
nearest one on either side is kept (a plain aggregate, combined before the shuffle), and left records are joined by equality
of entity and tick. Where stamps are finer than the ticks, right records inside the left record's own tick are found by a
window over that one tick, which emits a row per record and no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_days(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, right_id: str, tolerance: int) -> DataFrame:
    """``left`` with match_id and match_day: the right row of the same ``on`` whose date is nearest, at most ``tolerance`` days away.

    The tick is the day, so the kept row is the match: on a tie the earlier date, then the smaller id. Left rows with a null
    key or date, or without a match, keep nulls; right rows with a null key, date or id never match; repeated left rows are
    each matched, repeated right rows give the smallest id. Columns of ``right`` other than those named play no part, so
    clashing names are no matter; an empty side is allowed.
    """
    left = left.drop("match_id", "match_day")
    keys = [f"__k{i}" for i in range(len(on))]
    r = right.select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.col(right_day).cast("date").alias("__d"), F.col(right_id).alias("__id")).dropna()
    r = r.groupBy(*keys, "__d").agg(F.min("__id").alias("__id"))
    ticks = r.withColumn("__off", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))).withColumn("__tick", F.date_add("__d", F.col("__off")))
    best = ticks.groupBy(*keys, "__tick").agg(F.min(F.struct(F.abs("__off").alias("away"), F.col("__d").alias("day"), F.col("__id").alias("id"))).alias("__best"))
    tick = F.col(left_day).cast("date")
    joined = left.join(best, [left[c] == best[k] for c, k in zip(on, keys, strict=True)] + [tick == best["__tick"]], "left")
    return joined.select(*(left[c] for c in left.columns), F.col("__best.id").alias("match_id"), F.col("__best.day").alias("match_day"))


def nearest_in_time(left: DataFrame, right: DataFrame, on: list[str], left_us: str, right_us: str, right_id: str, tolerance_us: int, ticks: int = 6) -> DataFrame:
    """``left`` with match_id and match_us: the right row of the same ``on`` nearest in microseconds, at most ``tolerance_us`` away (inclusive).

    A tick is a ``ticks``-th of the tolerance. On a tie the earlier instant wins, then the smaller id. Nulls, repeated rows,
    clashing names and empty sides are treated as in ``nearest_in_days``.
    """
    left = left.drop("match_id", "match_us")
    width = max(1, tolerance_us // ticks)
    reach = -(-tolerance_us // width)
    keys = [f"__k{i}" for i in range(len(on))]
    own_tick = F.expr(f"(__us - pmod(__us, {width}L)) div {width}L")
    r = right.select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.col(right_us).cast("long").alias("__us"), F.col(right_id).alias("__id")).dropna()
    r = r.groupBy(*keys, "__us").agg(F.min("__id").alias("__id")).withColumn("__own", own_tick)
    others = F.array(*(F.lit(k) for k in range(-reach, reach + 1) if k))  # the own tick is looked at below
    spread = r.withColumn("__off", F.explode(others)).withColumn("__cell", F.col("__own") + F.col("__off"))
    at = F.struct(F.col("__us").alias("us"), (-F.col("__id")).alias("minus_id"))
    # the nearest on either side: the last before the tick, the first after it
    kept = spread.groupBy(*keys, "__cell").agg(F.max(F.when(F.col("__off") > 0, at)).alias("__before"), F.min(F.when(F.col("__off") < 0, F.struct(F.col("__us").alias("us"), F.col("__id").alias("id")))).alias("__after"))

    stamped = left.withColumn("__t", F.col(left_us).cast("long"))
    once = stamped.select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), F.col("__t").alias("__us")).dropna().distinct().withColumn("__cell", own_tick)
    no_id = F.lit(None).cast(r.schema["__id"].dataType)
    # inside the tick: the last right record at or before the left instant, and the first after it
    both = once.withColumn("__id", no_id).withColumn("__side", F.lit(1)).unionByName(r.select(*keys, "__us", F.col("__own").alias("__cell"), "__id").withColumn("__side", F.lit(0)))
    is_right = F.col("__side") == 0
    w = Window.partitionBy(*keys, "__cell")
    seen = F.when(is_right, F.struct(F.col("__us").alias("us"), F.col("__id").alias("id")))
    inside = (
        both.withColumn("__in_before", F.last(seen, ignorenulls=True).over(w.orderBy("__us", "__side").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__in_after", F.first(seen, ignorenulls=True).over(w.orderBy("__us", "__side").rowsBetween(1, Window.unboundedFollowing)))
        .where("__side = 1")
        .drop("__id", "__side")
    )
    found = inside.join(kept, [*keys, "__cell"], "left")

    def candidate(us: Column, id_: Column) -> Column:
        away = F.abs(us - F.col("__us"))
        return F.when(away <= tolerance_us, F.struct(away.alias("away"), us.alias("us"), id_.alias("id")))

    best = F.least(
        candidate(F.col("__before.us"), -F.col("__before.minus_id")),
        candidate(F.col("__after.us"), F.col("__after.id")),
        candidate(F.col("__in_before.us"), F.col("__in_before.id")),
        candidate(F.col("__in_after.us"), F.col("__in_after.id")),
    )
    found = found.select(*keys, F.col("__us").alias("__m"), best.alias("__best")).where("__best IS NOT NULL")
    joined = stamped.join(found, [stamped[c] == found[k] for c, k in zip(on, keys, strict=True)] + [stamped["__t"] == found["__m"]], "left")
    return joined.select(*(stamped[c] for c in left.columns), F.col("__best.id").alias("match_id"), F.col("__best.us").alias("match_us"))
