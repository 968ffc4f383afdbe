"""The scorer: an estimated series of increments against a reference level."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quagmark.functions.scalar import WAVELENGTH_MM, datum, round_to_hour, season
from quagmark.operators.islands import chain
from quagmark.operators.stats import agreement, detrended, joined


class LockedError(ValueError):
    """Raised when locked years are scored without leave."""


@dataclass(frozen=True)
class Protocol:
    """What is fixed before scoring: ends of datums, season, spring window, least epochs, locked years."""

    datum_breaks: list[str] = field(default_factory=list)
    season_months: tuple[int, int] = (5, 11)
    spring_window: tuple[int, int] = (3, 6)
    min_epochs: int = 6
    locked_years: tuple[int, ...] = ()


def guard(pairs: DataFrame, t1: str, t2: str, protocol: Protocol, leave: bool = False) -> None:
    """Refuses locked years unless ``leave`` is given."""
    if leave or not protocol.locked_years:
        return
    years = [F.year(t1), F.year(t2)]
    if not pairs.where(years[0].isin(*protocol.locked_years) | years[1].isin(*protocol.locked_years)).isEmpty():
        raise LockedError(f"years {protocol.locked_years} are locked")


def with_truth(levels: DataFrame, truth: DataFrame, on: list[str], time: str, level: str) -> DataFrame:
    """Levels with the reference at their time rounded to the hour, by equality."""
    t = truth.select(*on, F.col(time).alias("__h"), F.col(level).alias("truth"))
    return levels.withColumn("__h", round_to_hour(F.col("time"))).join(t, [*on, "__h"], "left").drop("__h")


def views(levels: DataFrame, on: list[str], protocol: Protocol) -> DataFrame:
    """Levels once per view (whole span, datum, season and datum), each segment of a view set to zero at its first epoch."""
    m = F.month("time")
    inside = m.between(*protocol.season_months)
    labels = F.array(F.lit("span"), F.concat(F.lit("datum "), datum(F.col("time"), protocol.datum_breaks)), F.when(inside, F.concat_ws(" ", F.lit("season"), F.year("time").cast("string"), datum(F.col("time"), protocol.datum_breaks))))
    v = levels.withColumn("view", F.explode(F.array_compact(labels)))
    w = Window.partitionBy(*on, "view", "seg").orderBy("time")
    zeroed = {c: F.col(c) - F.first(c).over(w) for c in ("est", "truth")}
    return v.withColumns(zeroed)


def increments(df: DataFrame, on: list[str], truth: str, est: str, wavelength_mm: float = WAVELENGTH_MM) -> DataFrame:
    """Agreement of increments, with the share within a quarter wavelength."""
    known = df.where(F.col(truth).isNotNull() & F.col(est).isNotNull())
    near = known.groupBy(*on).agg(F.avg((F.abs(F.col(est) - F.col(truth)) < wavelength_mm / 4).cast("double")).alias("within"))
    return joined(agreement(known, on, truth, est), near, on)


def level_stats(viewed: DataFrame, on: list[str], protocol: Protocol) -> DataFrame:
    """Per view with enough epochs: r, RMSE and amplitude ratio of the two series after each lost its line, and the shares within 5 and 10 mm."""
    known = viewed.where(F.col("truth").isNotNull() & F.col("est").isNotNull()).withColumn("__t", F.unix_micros("time") / 86_400e6)
    keys = [*on, "view"]
    both = detrended(detrended(known, keys, "__t", "est", "__e"), keys, "__t", "truth", "__u")
    within = both.groupBy(*keys).agg(F.avg((F.abs(F.col("__e") - F.col("__u")) < 5).cast("double")).alias("within_5"), F.avg((F.abs(F.col("__e") - F.col("__u")) < 10).cast("double")).alias("within_10"))
    return agreement(both, keys, "__u", "__e").where(F.col("n") >= protocol.min_epochs).select(*keys, "n", "r", "rmse", "amplitude_ratio").join(within, keys)


def winter_steps(levels: DataFrame, on: list[str], protocol: Protocol) -> DataFrame:
    """Step of estimate and truth from a season's last epoch to the first of the next spring, in one segment and datum."""
    d = datum(F.col("time"), protocol.datum_breaks)
    rows = levels.withColumns({"year": F.year("time"), "__d": d})
    item = F.struct("time", "est", "truth", "__d", "seg")
    last = rows.where(F.month("time").between(*protocol.season_months)).groupBy(*on, "year").agg(F.max(item).alias("a"))
    first = rows.where(F.month("time").between(*protocol.spring_window)).groupBy(*on, (F.col("year") - 1).alias("year")).agg(F.min(item).alias("b"))
    j = last.join(first, [*on, "year"]).where((F.col("a.__d") == F.col("b.__d")) & (F.col("a.seg") == F.col("b.seg")))
    return j.select(*on, F.col("year").alias("winter"), (F.col("b.est") - F.col("a.est")).alias("est_step"), (F.col("b.truth") - F.col("a.truth")).alias("truth_step"))


def relevel(levels: DataFrame, on: list[str], steps: DataFrame, t: str, delta: str) -> DataFrame:
    """Levels shifted, from each bound on, by all corrections so far: ``steps`` has (on, t, delta)."""
    union = levels.withColumn("__d", F.lit(0.0)).unionByName(steps.select(*on, F.col(t).alias("time"), F.col(delta).alias("__d")), allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    return union.withColumn("__s", F.sum("__d").over(w)).where("seg IS NOT NULL").withColumn("est", F.col("est") + F.col("__s")).drop("__d", "__s")


def score(pairs: DataFrame, truth: DataFrame, on: list[str], protocol: Protocol, leave: bool = False) -> dict[str, DataFrame]:
    """Tables levels, winters, increments, seasons and years of pairs (t1, t2, est_mm, truth_inc_mm) and hourly truth (time, level)."""
    guard(pairs, "t1", "t2", protocol, leave)
    levels = with_truth(chain(pairs, on, "t1", "t2", "est_mm"), truth, on, "time", "level")
    tagged = pairs.withColumns({"season": season(F.col("t1")), "year": F.year("t1")})
    return {
        "levels": level_stats(views(levels, on, protocol), on, protocol), "winters": winter_steps(levels, on, protocol), "increments": increments(tagged, on, "truth_inc_mm", "est_mm"),
        "seasons": increments(tagged, [*on, "season"], "truth_inc_mm", "est_mm"), "years": increments(tagged, [*on, "year"], "truth_inc_mm", "est_mm"),
    }
