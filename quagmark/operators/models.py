"""Small models fitted over parameter grids by sums, gated fusion, cycle ties, nested selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quagmark.operators.islands import ordered


def grid_fit(df: DataFrame, on: list[str], parameter: str, x1: Column, x2: Column, y: Column) -> DataFrame:
    """Per key the ``parameter`` value, and coefficients of y on x1 and x2 without intercept, of the smallest squared error; one pass of sums for all values."""
    known = df.where(x1.isNotNull() & x2.isNotNull() & y.isNotNull())
    s = known.groupBy(*on, parameter).agg(*(F.sum(e).alias(n) for n, e in {"a": x1 * x1, "b": x1 * x2, "c": x2 * x2, "p": x1 * y, "q": x2 * y, "yy": y * y}.items()), F.count("*").alias("n"))
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    s = s.where(det > 1e-12).withColumns({"k1": (F.col("c") * F.col("p") - F.col("b") * F.col("q")) / det, "k2": (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det})
    s = s.withColumn("sse", F.col("yy") - F.col("k1") * F.col("p") - F.col("k2") * F.col("q"))
    best = F.min(F.struct(F.round("sse", 6).alias("sse"), parameter, "k1", "k2", "n")).alias("m")
    return s.groupBy(*on).agg(best).select(*on, f"m.{parameter}", "m.k1", "m.k2", "m.sse", "m.n")


def fuse(df: DataFrame, on: list[str], order: str, u: str, q: str, z: str, r: str, gate: float = 3.0) -> DataFrame:
    """``df`` with ``fused``, u corrected by z with the weight of its variance, unless z is missing or beyond ``gate`` deviations, and ``level``, the running sum."""
    gap, var = F.col(z) - F.col(u), F.col(q) + F.col(r)
    use = F.col(z).isNotNull() & (F.abs(gap) <= gate * F.sqrt(var))
    d = df.withColumn("fused", F.when(use, F.col(u) + F.try_divide(F.col(q), var) * gap).otherwise(F.col(u)))
    return d.withColumn("level", F.sum("fused").over(ordered(on, order).rowsBetween(Window.unboundedPreceding, 0)))


def phase_biases(df: DataFrame, on: list[str], order: str, p1: str, p2: str, p3: str) -> DataFrame:
    """Closures of 1-, 2- and 3-step interferograms: c2 = two ones minus a two, c3 = three ones minus a three, wrapped."""
    from quagmark.operators.circular import wrap

    w = ordered(on, order)
    one, two = F.lead(p1, 1).over(w), F.lead(p1, 2).over(w)
    return df.withColumns({"c2": wrap(F.col(p1) + one - F.col(p2)), "c3": wrap(F.col(p1) + one + two - F.col(p3))})


def tie_segments(levels: DataFrame, on: list[str], seg: str, level: str, prior: str) -> DataFrame:
    """Every segment shifted by the mean distance of the prior from it; a segment without a prior keeps its level."""
    own = Window.partitionBy(*on, seg)
    shift = F.coalesce(F.avg(F.col(prior) - F.col(level)).over(own), F.lit(0.0))
    return levels.withColumn(level, F.col(level) + shift)


def bucket_fit(days: DataFrame, on: list[str], day: str, level: str, rain: str, pet: str) -> DataFrame:
    """Per key the coefficients of next day's change on (rain, pet, level, 1), by sums of products."""
    from quagmark.operators.stats import fit

    d = days.withColumn("__dw", F.lead(level).over(ordered(on, day)) - F.col(level))
    return fit(d, on, [F.col(rain), F.col(pet), F.col(level), F.lit(1.0) + 0 * F.col(level)], F.col("__dw"), 8)


def ou_parameters(df: DataFrame, on: list[str], t: str, x: str, max_lag: int) -> DataFrame:
    """Standard deviation and e-folding time of an Ornstein-Uhlenbeck process: the slope of the log autocorrelation over lag."""
    from quagmark.operators.stats import autocorrelation

    rho = autocorrelation(df, on, t, x, max_lag).where("lag > 0 AND rho > 0.05")
    slope = rho.groupBy(*on).agg((F.sum(F.col("lag") * F.ln("rho")) / F.sum(F.col("lag") * F.col("lag"))).alias("s"))
    sd = df.groupBy(*on).agg(F.stddev_pop(x).alias("sigma"))
    joined = slope.join(sd, on) if on else slope.join(sd, how="cross")
    return joined.select(*on, "sigma", F.when(F.col("s") < 0, -1 / F.col("s")).alias("tau"))


def nested_selection(df: DataFrame, on: list[str], columns: list[str], y: str, most: int = 200) -> DataFrame:
    """Per key leave-one-out predictions where the best single column is chosen anew without each row: (row, chosen, predicted). For yearly tables, at most ``most`` rows a key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in on)

    def loo(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        n = len(v)
        sx, sy, sxx, sxy = x.sum() - x, v.sum() - v, (x * x).sum() - x * x, (x * v).sum() - x * v
        det = (n - 1) * sxx - sx * sx
        slope = np.where(det > 1e-12, ((n - 1) * sxy - sx * sy) / np.where(det > 1e-12, det, 1), 0)
        return (sy - slope * sx) / (n - 1) + slope * x

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=[*columns, y]).sort_values([*columns, y]).reset_index(drop=True)
        if len(p) > most:
            raise ValueError(f"more than {most} rows in a key")
        out = []
        for i in range(len(p) if len(p) > 3 else 0):
            rest = p.drop(index=i)
            errors = [((loo(rest[c].to_numpy(float), rest[y].to_numpy(float)) - rest[y].to_numpy(float)) ** 2).sum() for c in columns]
            c = columns[int(np.argmin(errors))]
            slope, cut = np.polyfit(rest[c].to_numpy(float), rest[y].to_numpy(float), 1)
            out.append((i, c, float(slope * p[c][i] + cut), float(p[y][i]), *key))
        return pd.DataFrame(out, columns=["row", "chosen", "predicted", "observed", *on])

    schema = "row int, chosen string, predicted double, observed double" + (f", {keys}" if on else "")
    return df.groupBy(*on).applyInPandas(work, schema)
