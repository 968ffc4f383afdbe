"""Zones and scenes: coherence and backscatter by zone, phenology, water, dispersion, comparisons of zones, decay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quagmark.operators.stats import corr, joined, standardized


def pair_stats(df: DataFrame, on: list[str], value: str, inside: Column, limit: float = 0.3) -> DataFrame:
    """Per pair the mean and median inside a mask and the share above ``limit`` of all its pixels, missing ones included."""
    v = F.when(inside, F.col(value))
    return df.groupBy(*on).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), (F.try_divide(F.count_if(inside & (F.col(value) > limit)), F.count_if(inside))).alias("share_above"))


def dispersion(df: DataFrame, on: list[str], amplitude: str) -> DataFrame:
    """Amplitude dispersion: population deviation over mean of amplitudes above 0; null for fewer than 2."""
    a = F.when(F.col(amplitude) > 0, F.col(amplitude))
    return df.groupBy(*on).agg(F.when(F.count(a) >= 2, F.stddev_pop(a) / F.avg(a)).alias("dispersion"), F.count(a).alias("n"))


def landcover_features(df: DataFrame, on: list[str], green: str, wet: str) -> DataFrame:
    """Per pixel mean greenness, its p90 - p10 amplitude, and mean wetness."""
    return df.groupBy(*on).agg(F.avg(green).alias("green"), (F.percentile(green, 0.9) - F.percentile(green, 0.1)).alias("amplitude"), F.avg(wet).alias("wet"))


def persistent(df: DataFrame, on: list[str], value: str, limit: float, share: float) -> DataFrame:
    """The pixels above ``limit`` in more than ``share`` of their known scenes."""
    return df.where(F.col(value).isNotNull()).groupBy(*on).agg(F.avg((F.col(value) > limit).cast("double")).alias("share")).where(F.col("share") > share)


def water_area(df: DataFrame, pixel: list[str], on: list[str], water: Column, valid: Column, threshold: float = 0.5, pixel_ha: float = 0.04) -> DataFrame:
    """Hectares of pixels that are water in at least ``threshold`` of their valid scenes."""
    p = df.groupBy(*on, *pixel).agg(F.avg(F.when(valid, water.cast("double"))).alias("__s"))
    return p.groupBy(*on).agg((F.count_if(F.col("__s") >= threshold) * pixel_ha).alias("ha"))


def phenology(df: DataFrame, zone: str, date: str, value: str) -> DataFrame:
    """Mean of the zone means by month."""
    scenes = df.groupBy(zone, date).agg(F.avg(value).alias("__m"))
    return scenes.groupBy(zone, F.month(date).alias("month")).agg(F.avg("__m").alias("mean"), F.count("__m").alias("n"))


def zone_series(df: DataFrame, zone: str, date: str, value: str, min_valid: float = 0.5) -> DataFrame:
    """Median of a zone per date; null where fewer than ``min_valid`` of its pixels are known."""
    return df.groupBy(zone, date).agg(F.when(F.count(value) >= min_valid * F.count("*"), F.median(value)).alias("median"), F.count(value).alias("n"))


def zone_deltas(df: DataFrame, pair: str, zone: str, value: str, a: str, b: str) -> DataFrame:
    """Per pair the difference of two zones' means: one pivot, no self-join."""
    g = df.where(F.col(zone).isin(a, b)).groupBy(pair).agg(F.avg(F.when(F.col(zone) == a, F.col(value))).alias("__a"), F.avg(F.when(F.col(zone) == b, F.col(value))).alias("__b"))
    return g.select(pair, (F.col("__a") - F.col("__b")).alias("delta")).where("delta IS NOT NULL")


def gain(df: DataFrame, on: list[str], value: str, condition: Column, min_n: int = 3) -> DataFrame:
    """Mean where the condition holds minus mean where it does not; null below ``min_n`` on either side."""
    g = df.groupBy(*on).agg(F.avg(F.when(condition, F.col(value))).alias("__a"), F.avg(F.when(~condition, F.col(value))).alias("__b"), F.count(F.when(condition, F.col(value))).alias("n_true"), F.count(F.when(~condition, F.col(value))).alias("n_false"))
    return g.select(*on, F.when((F.col("n_true") >= min_n) & (F.col("n_false") >= min_n), F.col("__a") - F.col("__b")).alias("gain"), "n_true", "n_false")


def decay(df: DataFrame, on: list[str], days: str, coh: str, taus: list[float]) -> DataFrame:
    """Per key ginf + (g0 - ginf) exp(-t / tau): for every tau of a grid a 2 x 2 least-squares fit from sums, the tau of the smallest error wins."""
    e = F.exp(-F.col(days) / F.col("tau"))
    d = df.where(F.col(coh).isNotNull() & F.col(days).isNotNull()).withColumn("tau", F.explode(F.array(*map(F.lit, map(float, taus)))))
    s = d.groupBy(*on, "tau").agg(F.count("*").alias("n"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"), F.sum(coh).alias("y"), F.sum(e * F.col(coh)).alias("ey"), F.sum(F.col(coh) * F.col(coh)).alias("yy"))
    det = F.col("n") * F.col("ee") - F.col("e") * F.col("e")
    s = s.where(det > 1e-12).withColumns({"__b": (F.col("n") * F.col("ey") - F.col("e") * F.col("y")) / det, "__a": (F.col("ee") * F.col("y") - F.col("e") * F.col("ey")) / det})
    s = s.withColumn("sse", F.col("yy") - F.col("__a") * F.col("y") - F.col("__b") * F.col("ey"))
    best = s.groupBy(*on).agg(F.min(F.struct(F.round("sse", 9).alias("s"), "tau", "__a", "__b", "n")).alias("b"))
    return best.select(*on, F.col("b.tau").alias("tau"), (F.col("b.__a") + F.col("b.__b")).alias("g0"), F.col("b.__a").alias("ginf"), F.col("b.n").alias("n"))


def column_links(df: DataFrame, cell: str, x: str, y: str, min_n: int = 5) -> DataFrame:
    """Per cell r and the slope through the origin of pairwise complete values; cells with fewer than ``min_n`` are left out."""
    k = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = k.groupBy(cell).agg(F.count("*").alias("n"), corr(x, y).alias("r"), F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))
    return g.where(F.col("n") >= min_n)


def correlation_length(grid: DataFrame, row: str, col: str, value: str, max_lag: int = 12) -> DataFrame:
    """Autocorrelation of a field by lag along rows and columns (joined by equality), and the first lag below 1/e."""
    m = standardized(grid.where(F.col(value).isNotNull()), [], value, "__z").select(row, col, "__z")
    lags = m.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    ahead = lags.select((F.col(row) + F.col("lag")).alias(row), col, "lag", F.col("__z").alias("__y")).unionByName(lags.select(row, (F.col(col) + F.col("lag")).alias(col), "lag", F.col("__z").alias("__y")))
    rho = ahead.join(m, [row, col]).groupBy("lag").agg(F.avg(F.col("__z") * F.col("__y")).alias("rho"), F.count("*").alias("n"))
    first = rho.agg(F.min(F.when(F.col("rho") < float(np.exp(-1)), F.col("lag"))).alias("length"))
    return joined(rho, first, [])


def kmeans_choice(df: DataFrame, vector: str, ks: range, seed: int = 0) -> pd.DataFrame:
    """Silhouette of k-means for each k (squared Euclidean distances), the best first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    v = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    rows = [(k, ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(v).transform(v))) for k in ks]
    return pd.DataFrame(rows, columns=["k", "silhouette"]).sort_values("silhouette", ascending=False)
