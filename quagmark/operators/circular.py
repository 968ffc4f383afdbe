"""Angles: wrapping, weighted circular means, closure of triangles, cycle choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap(x: Column | str) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(x), F.cos(x))


def phasor_sums(phase: Column, weight: Column) -> list[Column]:
    """The three sums of a weighted circular mean; they can be added up further."""
    return [F.sum(weight * F.sin(phase)).alias("s"), F.sum(weight * F.cos(phase)).alias("c"), F.sum(F.when(phase.isNotNull(), weight)).alias("w")]


def phasor(s: Column, c: Column, w: Column) -> tuple[Column, Column]:
    """(mean angle, resultant length) of the sums; null unless the weights add up to more than 0."""
    return F.when(w > 0, F.atan2(s, c)), F.when(w > 0, F.hypot(s, c) / w)


def phasor_mean(df: DataFrame, on: list[str], phase: Column, weight: Column, min_n: int = 1) -> DataFrame:
    """Per key the weighted circular mean ``phase`` and its consistency ``r``; null below ``min_n`` values."""
    g = df.where(phase.isNotNull() & weight.isNotNull()).groupBy(*on).agg(*phasor_sums(phase, weight), F.count("*").alias("n"))
    mean, r = phasor(F.col("s"), F.col("c"), F.col("w"))
    enough = F.col("n") >= min_n
    return g.select(*on, F.when(enough, mean).alias("phase"), F.when(enough, r).alias("r"), "n")


def double_difference(zones: DataFrame, pair: str, zone: str, phase: str, target: str, reference: str) -> DataFrame:
    """Per pair the wrapped difference of two zones' phases."""
    t = zones.where(F.col(zone) == target).select(pair, F.col(phase).alias("__t"))
    r = zones.where(F.col(zone) == reference).select(pair, F.col(phase).alias("__r"))
    return t.join(r, pair).select(pair, wrap(F.col("__t") - F.col("__r")).alias("dd"))


def triangles(pairs: DataFrame, on: list[str], t1: str, t2: str, phase: str, max_span_days: int) -> DataFrame:
    """Closed triangles (a, b, c) of pairs a-b, b-c and a-c within ``max_span_days``, by two equi-joins, with the wrapped closure."""
    p = pairs.where(F.col(phase).isNotNull() & (F.datediff(t2, t1) <= max_span_days))
    ab = p.select(*on, F.col(t1).alias("a"), F.col(t2).alias("b"), F.col(phase).alias("ab"))
    bc = p.select(*on, F.col(t1).alias("b"), F.col(t2).alias("c"), F.col(phase).alias("bc"))
    ac = p.select(*on, F.col(t1).alias("a"), F.col(t2).alias("c"), F.col(phase).alias("ac"))
    whole = ab.join(bc, [*on, "b"]).where(F.datediff("c", "a") <= max_span_days).join(ac, [*on, "a", "c"])
    return whole.withColumn("closure", wrap(F.col("ab") + F.col("bc") - F.col("ac")))


def cycles(offset: Column, cycle: float) -> Column:
    """Whole cycles in an offset, halves to even."""
    return F.rint(offset / cycle)


def wrap_to(x: Column, cycle: float) -> Column:
    """A length in (-cycle/2, cycle/2]."""
    r = x - cycle * F.rint(x / cycle)
    return F.when(r <= -cycle / 2, r + cycle).otherwise(r)


def choose_cycle(wrapped: Column, reference: Column, cycle: float) -> Column:
    """The value nearest to the reference that the wrapped one can stand for."""
    return wrapped + F.rint((reference - wrapped) / cycle) * cycle
