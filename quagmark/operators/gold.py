"""Gold tables: plot products with nearest drivers, pair drivers, daily truth, backscatter change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quagmark.operators.temporal import asof


def daily_truth(hourly: DataFrame, series: list[str], time: str, value: str, ok) -> DataFrame:
    """Per series and UTC day the mean, standard deviation (population) and count of the hours that are ok."""
    d = hourly.where(ok & F.col(value).isNotNull()).groupBy(*series, F.to_date(time).alias("date"))
    return d.agg(F.avg(value).alias("surface_cm"), F.stddev_pop(value).alias("surface_sd_cm"), F.count("*").cast("int").alias("n_ok_hours"))


def with_site(acquisitions: DataFrame, site: DataFrame, series: list[str], time: str, columns: list[str], minutes: int = 31, order: str | None = None) -> DataFrame:
    """Acquisitions with the site's columns at the nearest hour, at most ``minutes`` away."""
    return asof(acquisitions, site, series, time, columns, minutes * 60, "nearest", order, "site_")


def pair_changes(acquisitions: DataFrame, on: list[str], date: str, columns: list[str]) -> DataFrame:
    """Each acquisition with the next of its key: the two dates, the days between, and the change of every column."""
    w = Window.partitionBy(*on).orderBy(date)
    n = acquisitions.withColumns({"__t2": F.lead(date).over(w), **{f"__n_{c}": F.lead(c).over(w) for c in columns}}).where("__t2 IS NOT NULL")
    return n.select(*on, F.col(date).alias("t1"), F.col("__t2").alias("t2"), F.datediff("__t2", date).alias("revisit_days"), *((F.col(f"__n_{c}") - F.col(c)).alias(f"d_{c}") for c in columns))


def change_between(pairs: DataFrame, scenes: DataFrame, on: list[str], t1: str, t2: str, date: str, value: str, name: str) -> DataFrame:
    """Pairs with the change of ``value`` from t1 to t2, by two equi-joins; null where either scene is missing."""
    s = scenes.select(*on, F.col(date).alias("__d"), F.col(value).alias("__v"))
    a = pairs.join(s.withColumnsRenamed({"__d": t1, "__v": "__a"}), [*on, t1], "left")
    b = a.join(s.withColumnsRenamed({"__d": t2, "__v": "__b"}), [*on, t2], "left")
    return b.withColumn(name, F.col("__b") - F.col("__a")).drop("__a", "__b")


def units(plots: DataFrame, row: str, col: str, plot: str) -> DataFrame:
    """Plots that share a cell are one unit, named by all of them."""
    u = plots.select(row, col, plot).distinct().groupBy(row, col).agg(F.array_join(F.array_sort(F.collect_list(plot)), "+").alias("unit"))
    return plots.join(u, [row, col])
