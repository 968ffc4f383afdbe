"""Statistics as sums: regression, harmonics, robust scale, ranks, tests, agreement of two series."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quagmark.session import checkpointed


def both(x: Column, y: Column) -> Column:
    return x.isNotNull() & y.isNotNull()


def joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the one row of ``b`` per key; without keys ``b`` has one row in all."""
    return a.join(b, on, how) if on else a.join(b, how="cross")


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r over the rows in which both are known; null without spread (where the built-in raises an error in ANSI mode)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(both(x, y), x), F.when(both(x, y), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def lines(df: DataFrame, on: list[str], x: str, y: str, min_n: int = 2) -> DataFrame:
    """Per key n, the slopes by least squares, total least squares, reduced major axis and through the origin, intercept, r and R2."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*on).agg(
        F.count("*").alias("n"), F.avg(x).alias("__mx"), F.avg(y).alias("__my"), F.var_samp(x).alias("__sxx"), F.var_samp(y).alias("__syy"), F.covar_samp(x, y).alias("__sxy"),
        F.sum(F.col(x) * F.col(y)).alias("__xy"), F.sum(F.col(x) * F.col(x)).alias("__xx"),
    )
    sxx, syy, sxy = F.col("__sxx"), F.col("__syy"), F.col("__sxy")
    ok = lambda c, cond: F.when((F.col("n") >= min_n) & cond, c)
    slope = F.try_divide(sxy, sxx)
    return d.select(
        *on, "n",
        ok(slope, sxx > 0).alias("slope"), ok(F.col("__my") - slope * F.col("__mx"), sxx > 0).alias("intercept"),
        ok((syy - sxx + F.sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy), sxy != 0).alias("tls"),
        ok(F.signum(sxy) * F.sqrt(F.try_divide(syy, sxx)), sxx > 0).alias("rma"),
        ok(F.try_divide(F.col("__xy"), F.col("__xx")), F.col("__xx") > 0).alias("slope_origin"),
        ok(sxy / F.sqrt(sxx * syy), (sxx > 0) & (syy > 0)).alias("r"), ok(sxy * sxy / (sxx * syy), (sxx > 0) & (syy > 0)).alias("r2"),
    )


def normal_sums(columns: list[Column], y: Column) -> list[Column]:
    """The sums of products of a regression's columns among themselves (upper triangle) and with y."""
    k = len(columns)
    out = [F.sum(columns[i] * columns[j]).alias(f"__a{i}_{j}") for i in range(k) for j in range(i, k)]
    return [*out, *(F.sum(columns[i] * y).alias(f"__b{i}") for i in range(k)), F.sum(y * y).alias("__yy"), F.sum(y).alias("__y"), F.count(y).alias("__n")]


def fit(df: DataFrame, on: list[str], columns: list[Column], y: Column, min_n: int) -> DataFrame:
    """Per key the coefficients ``b`` (an array) of the least-squares fit of y on columns, with n and R2; null for singular or short keys.

    The sums are ordinary aggregates; only the small system per key is solved in numpy, on arrays.
    """
    k = len(columns)
    every = y.isNotNull()
    for c in columns:
        every = every & c.isNotNull()
    sums = df.where(every).groupBy(*on).agg(*normal_sums(columns, y))
    packed = sums.select(*on, F.col("__n").alias("n"), F.array(*(F.col(f"__a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k))).alias("__A"), F.array(*(F.col(f"__b{i}") for i in range(k))).alias("__B"), "__yy", "__y")

    @F.pandas_udf("array<double>")
    def solved(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, z in zip(a, b, strict=True):
            m = np.asarray(x, float).reshape(k, k)
            scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
            m = m / np.outer(scale, scale)
            out.append(np.linalg.solve(m, np.asarray(z, float) / scale) / scale if np.linalg.matrix_rank(m, tol=1e-10) == k else None)
        return pd.Series(out)

    done = packed.withColumn("b", F.when(F.col("n") >= min_n, solved("__A", "__B")))
    explained = F.aggregate(F.zip_with("b", "__B", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    total = F.col("__yy") - F.col("__y") * F.col("__y") / F.col("n")
    return done.select(*on, "n", "b", F.when(total > 0, 1 - (F.col("__yy") - explained) / total).alias("r2"))


def annual_columns(years: Column) -> list[Column]:
    """1, t, cos and sin of the yearly cycle."""
    return [F.lit(1.0) + 0 * years, years, F.cos(2 * math.pi * years), F.sin(2 * math.pi * years)]


def harmonic(df: DataFrame, on: list[str], years: Column, y: Column, min_n: int = 6) -> DataFrame:
    """Per key the annual semi-amplitude, the day of its maximum, the trend per year and R2."""
    f = fit(df, on, annual_columns(years), y, min_n)
    c, s = F.col("b")[2], F.col("b")[3]
    return f.select(*on, "n", F.hypot(c, s).alias("amplitude"), (F.pmod(F.atan2(s, c) / (2 * math.pi), F.lit(1.0)) * 365.25).alias("phase_doy"), F.col("b")[1].alias("trend"), "r2")


def harmonic_covariance(df: DataFrame, on: list[str], years: Column, y: Column, min_n: int = 6) -> DataFrame:
    """Per key the cosine and sine parts of the yearly cycle and their covariance: (n, cos, sin, cc, ss, cs), from sums of products only; null for singular or short keys."""
    columns = annual_columns(years)
    k = len(columns)
    known = df.where(years.isNotNull() & y.isNotNull()).groupBy(*on).agg(*normal_sums(columns, y))
    packed = known.select(*on, F.col("__n").alias("n"), F.array(*(F.col(f"__a{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)), *(F.col(f"__b{i}") for i in range(k)), F.col("__yy")).alias("__v"))

    @F.pandas_udf("struct<cos:double,sin:double,cc:double,ss:double,cs:double>")
    def parts(v: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for x, m in zip(v, n, strict=True):
            x = np.asarray(x, float)
            a, b, yy = x[: k * k].reshape(k, k), x[k * k : -1], x[-1]
            scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
            if m < max(min_n, k + 1) or np.linalg.matrix_rank(a / np.outer(scale, scale), tol=1e-10) < k:
                out.append([None] * 5)
                continue
            inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
            beta = inverse @ b
            cov = inverse * max(yy - beta @ b, 0.0) / (m - k)
            out.append([beta[2], beta[3], cov[2, 2], cov[3, 3], cov[2, 3]])
        return pd.DataFrame(out, columns=["cos", "sin", "cc", "ss", "cs"], dtype=float)

    return packed.select(*on, "n", parts("__v", "n").alias("p")).select(*on, "n", "p.*")


def detrended(df: DataFrame, on: list[str], x: str, y: str, name: str) -> DataFrame:
    """``df`` with the residual of y from its line in x."""
    line = lines(df, on, x, y).select(*on, F.col("slope").alias("__s"), F.col("intercept").alias("__i"))
    return joined(df, line, on, "left").withColumn(name, F.col(y) - F.col("__i") - F.col("__s") * F.col(x)).drop("__s", "__i")


def leave_one_group_out_slope(df: DataFrame, group: str, x: str, y: str, min_train: int = 6) -> DataFrame:
    """Per group the slope through the origin of all other groups: totals minus own sums, without a refit."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.count("*").alias("n"))
    every = Window.partitionBy()
    rest = lambda c: F.sum(c).over(every) - F.col(c)
    return g.select(group, F.when(rest("n") >= min_train, F.try_divide(rest("xy"), rest("xx"))).alias("slope"))


def leave_one_out_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``df`` with ``loo``, each row's prediction by the line through all other rows."""
    terms = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}
    df = joined(df, df.agg(*(F.sum(v).alias(f"__{k}") for k, v in terms.items())), [])
    n, sx, sy = F.col("__n") - 1, F.col("__x") - F.col(x), F.col("__y") - F.col(y)
    sxx, sxy = F.col("__xx") - F.col(x) * F.col(x), F.col("__xy") - F.col(x) * F.col(y)
    slope = F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)
    return df.withColumn("loo", (sy - slope * sx) / n + slope * F.col(x)).drop(*(f"__{k}" for k in terms))


def partial_r(df: DataFrame, on: list[str], x: str, y: str, z: str) -> DataFrame:
    """Per key the correlation of x and y with z held constant."""
    known = df.dropna(subset=[x, y, z])
    g = known.groupBy(*on).agg(corr(x, y).alias("a"), corr(x, z).alias("b"), corr(y, z).alias("c"))
    return g.select(*on, F.try_divide(F.col("a") - F.col("b") * F.col("c"), F.sqrt((1 - F.col("b") * F.col("b")) * (1 - F.col("c") * F.col("c")))).alias("partial_r"))


#: Parts that the values of a key are cut into for running sums, and how exactly the cuts are taken.
PARTS, ACCURACY = 32, 1_000


def in_parts(groups: DataFrame, on: list[str], value: str) -> DataFrame:
    """``groups`` with ``__part``: each key's values cut into ranges of about equal size, so that no window holds a whole key.

    The groups, which are read several times, and the cuts, which are approximate quantiles and must be the same for every use, are materialised. What is computed over the parts is exact.
    """
    groups = checkpointed(groups)
    cuts = checkpointed(groups.groupBy(*on).agg(F.percentile_approx(F.col(value).cast("double"), [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("__cuts")))
    # how many cuts are at or below the value, by bisection: five looks at the array
    v, halves = F.col(value).cast("double"), F.array(*(F.lit(k) for k in (16, 8, 4, 2, 1)))
    part = F.aggregate(halves, F.lit(0), lambda p, step: F.when(F.get("__cuts", p + step - 1) <= v, p + step).otherwise(p))
    return joined(groups, cuts, on).withColumn("__part", part).drop("__cuts")


def running(groups: DataFrame, on: list[str], value: str, sums: list[str]) -> DataFrame:
    """``groups`` (one row per key and value) with ``c_<sum>``, the sum up to and with the value, and ``t_<sum>``, the key's total, for each of ``sums``."""
    cut = in_parts(groups, on, value)
    whole, before = Window.partitionBy(*on), Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy(*on, "__part").agg(*(F.sum(c).alias(c) for c in sums))
    parts = parts.select(*on, "__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__b_{c}") for c in sums), *(F.sum(c).over(whole).alias(f"t_{c}") for c in sums))
    own = Window.partitionBy(*on, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(parts, [*on, "__part"]).withColumns({f"c_{c}": F.sum(c).over(own) + F.col(f"__b_{c}") for c in sums})
    return out.drop("__part", *(f"__b_{c}" for c in sums))


def ranked(df: DataFrame, on: list[str], value: str, name: str, ties: str | None = None) -> DataFrame:
    """``df`` with the rank of ``value`` per key, ties at their mean, and the number of equal values as ``ties``; null for null."""
    counts = running(df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("n")), on, value, ["n"])
    ranks = counts.select(*on, value, (F.col("c_n") - (F.col("n") - 1) / 2.0).alias(name), *([F.col("n").alias(ties)] if ties else []))
    return df.join(ranks, [*on, value], "left")


def average_rank(on: list[str], value: str) -> Column:
    """Rank with ties at their mean, as a window over each key (for keys of bounded size; ``ranked`` has none)."""
    return F.rank().over(Window.partitionBy(*on).orderBy(value)) + (F.count("*").over(Window.partitionBy(*on, value)) - 1) / 2.0


def spearman(df: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    both_ranked = ranked(ranked(df.dropna(subset=[x, y]), on, x, "__rx"), on, y, "__ry")
    return both_ranked.groupBy(*on).agg(corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    # The formula's coefficients.
    p, a = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    u = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + p * u)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    half = 0.5 * poly * F.exp(-u * u)
    return F.when(z >= 0, 1 - half).otherwise(half)


def mann_whitney(df: DataFrame, on: list[str], value: str, first: Column) -> DataFrame:
    """U of the rows with ``first`` against the others, and the two-sided p by the tie-corrected normal approximation."""
    d = df.dropna(subset=[value]).withColumn("__f", first)
    t = F.col("__t").cast("double")
    g = ranked(d, on, value, "__r", "__t").groupBy(*on).agg(F.sum(F.when(F.col("__f"), F.col("__r"))).alias("__R"), F.count_if("__f").alias("n1"), F.count_if(~F.col("__f")).alias("n2"), F.sum(t * t - 1).alias("__ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("__R") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("__ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / sd
    return g.select(*on, "n1", "n2", u.alias("u"), (2 * (1 - normal_cdf(z))).alias("p"))


#: Up to so many values without ties the tests' p is exact.
EXACT_WILCOXON, EXACT_KENDALL = 50, 33


@lru_cache(maxsize=256)
def _shares(n: int, signed: bool) -> np.ndarray:
    """Cumulative null distribution of the sum of signed ranks, or of the number of inversions, of n values."""
    counts = np.ones(1)
    for k in range(1, n + 1):
        longer = np.zeros(len(counts) + (k if signed else k - 1))
        for step in (0, k) if signed else range(k):
            longer[step : step + len(counts)] += counts
        counts = longer / longer.sum()
    return np.cumsum(counts)


def _exact_p(signed: bool) -> Callable:
    @F.pandas_udf(T.DoubleType())
    def p(n: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(m) else min(1.0, 2 * float(_shares(int(m), signed)[int(k)])) for m, k in zip(n, least, strict=True)], dtype=float)

    return p


def wilcoxon(df: DataFrame, on: list[str], delta: str) -> DataFrame:
    """Signed-rank sums of non-zero differences and the two-sided p: exact for up to 50 differences without ties, else by the tie-corrected normal approximation."""
    d = df.where((F.col(delta).isNotNull()) & (F.col(delta) != 0)).withColumn("__a", F.abs(delta))
    r = ranked(d, on, "__a", "__r", "__t")
    t = F.col("__t").cast("double")
    g = r.groupBy(*on).agg(F.count("*").alias("n"), F.sum(F.when(F.col(delta) > 0, F.col("__r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(delta) < 0, F.col("__r")).otherwise(0.0)).alias("w_minus"), F.sum(t * t - 1).alias("__ties"))
    # a double: the cube of 1.7 million is beyond 64 bits
    n = F.col("n").cast("double")
    z = F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("__ties") / 48)
    exact = (n <= EXACT_WILCOXON) & (F.col("__ties") == 0)
    g = g.withColumn("__e", _exact_p(True)(F.when(exact, n), F.least("w_plus", "w_minus")))
    return g.withColumn("p", F.when(exact, F.col("__e")).otherwise(2 * (1 - normal_cdf(z)))).drop("__ties", "__e")


def _tie_sums(df: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """Per key the sums over groups of equal values that tie corrections take."""
    t = F.col("__t").cast("double")
    g = df.groupBy(*on, value).agg(F.count("*").alias("__t"))
    return g.groupBy(*on).agg(F.sum(t * (t - 1) / 2).alias(f"__{name}p"), F.sum(t * (t - 1) * (t - 2)).alias(f"__{name}0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"__{name}1"))


def theil_sen(df: DataFrame, on: list[str], x: str, y: str, z: float = 1.959964) -> DataFrame:
    """The median of all pairwise slopes with its interval and intercept, Kendall's tau-b with its two-sided p, and the number of slopes.

    For short series of years or months: all pairs of a key are formed. ``z``: the normal quantile of the interval. p is exact for up
    to 33 values without ties, else by the tie-corrected normal approximation.
    """
    known = df.dropna(subset=[x, y]).select(*on, F.col(x).alias("x1"), F.col(y).alias("y1"))
    middle = joined(known.groupBy(*on).agg(F.count("*").alias("n"), F.median("x1").alias("__mx"), F.median("y1").alias("__my")), _tie_sums(known, on, "x1", "x"), on)
    middle = joined(middle, _tie_sums(known, on, "y1", "y"), on)
    n, m = F.col("n"), F.col("n") * (F.col("n") - 1).cast("double")
    var = (m * (2 * n + 5) - F.col("__x1") - F.col("__y1")) / 18 + F.try_divide(2 * F.col("__xp") * F.col("__yp"), m) + F.coalesce(F.try_divide(F.col("__x0") * F.col("__y0"), 9 * m * (n - 2)), F.lit(0.0))
    middle = middle.withColumns({"__var": var, "__pairs": m / 2})
    p = joined(known, known.select(*on, F.col("x1").alias("x2"), F.col("y1").alias("y2")), on).where("x2 > x1").withColumns({"s": F.signum(F.col("y2") - F.col("y1")), "slope": (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))})
    w = Window.partitionBy(*on)
    p = p.withColumns({"__k": F.row_number().over(w.orderBy("slope")) - 1, "__nt": F.count("*").over(w)})
    p = joined(p, middle, on)
    half = z * F.sqrt((m * (2 * n + 5) - F.col("__x1") - F.col("__y1")) / 18)
    low = F.greatest(F.rint((F.col("__nt") - half) / 2) - 1, F.lit(0))
    high = F.least(F.rint((F.col("__nt") + half) / 2), F.col("__nt") - 1)
    at = lambda k: F.max(F.when(F.col("__k") == k, F.col("slope")))
    kept = ["n", "__mx", "__my", "__var", "__pairs", "__xp", "__yp"]
    g = p.groupBy(*on).agg(F.median("slope").alias("slope"), at(low).alias("low"), at(high).alias("high"), F.sum("s").alias("__s"), F.count("*").alias("pairs"), *(F.first(c).alias(c) for c in kept))
    untied = (F.col("__xp") == 0) & (F.col("__yp") == 0) & (n <= EXACT_KENDALL)
    swaps = F.when(untied, F.least((F.col("__pairs") - F.col("__s")) / 2, (F.col("__pairs") + F.col("__s")) / 2))
    g = g.withColumn("__e", _exact_p(False)(F.when(untied, n), swaps))
    tau = F.try_divide(F.col("__s"), F.sqrt((F.col("__pairs") - F.col("__xp")) * (F.col("__pairs") - F.col("__yp"))))
    return g.select(*on, "slope", (F.col("__my") - F.col("slope") * F.col("__mx")).alias("intercept"), "low", "high", tau.alias("tau"), F.when(untied, F.col("__e")).otherwise(2 * (1 - normal_cdf(F.abs("__s") / F.sqrt("__var")))).alias("p"), "pairs")


def quantile_bins(df: DataFrame, on: list[str], x: str, n_bins: int) -> DataFrame:
    """``df`` with ``bin``, the number of the quantile bin of x per key: edges are exact quantiles, equal edges count once, the last bin is closed."""
    edges = df.groupBy(*on).agg(F.array_sort(F.array_distinct(F.percentile(x, [k / n_bins for k in range(n_bins + 1)]))).alias("__e"))
    inside = F.size(F.filter("__e", lambda e: e <= F.col(x)))
    return joined(df, edges, on).withColumn("bin", F.when(F.col(x).isNotNull(), F.least(inside, F.size("__e") - 1) - 1)).drop("__e")


def envelope_slope(df: DataFrame, on: list[str], x: str, y: str, n_bins: int, q: float, least_bins: int = 3) -> DataFrame:
    """Per key the slope of the q-quantile of y over the median x of the quantile bins of x; null for fewer than ``least_bins`` bins."""
    b = quantile_bins(df.dropna(subset=[x, y]), on, x, n_bins).groupBy(*on, "bin").agg(F.median(x).alias("mx"), F.percentile(y, q).alias("qy"))
    return lines(b, on, "mx", "qy", least_bins).select(*on, F.col("n").alias("bins"), "slope")


def bh_qvalues(df: DataFrame, on: list[str], p: str) -> DataFrame:
    """``df`` with Benjamini-Hochberg ``q``; null for null p."""
    known = df.where(F.col(p).isNotNull())
    # rows of equal p have the q of the last of them, so distinct values do; the least is taken from above
    steps = running(known.groupBy(*on, p).agg(F.count("*").alias("n")), on, p, ["n"]).withColumn("__s", F.col(p) * F.col("t_n") / F.col("c_n"))
    cut = in_parts(steps, on, p)
    after = Window.partitionBy(*on).orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    parts = cut.groupBy(*on, "__part").agg(F.min("__s").alias("__m")).select(*on, "__part", F.min("__m").over(after).alias("__after"))
    own = Window.partitionBy(*on, "__part").orderBy(p).rowsBetween(0, Window.unboundedFollowing)
    q = cut.join(parts, [*on, "__part"]).select(*on, p, F.least(F.lit(1.0), F.min("__s").over(own), "__after").alias("q"))
    return df.join(q, [*on, p], "left")


def medians(df: DataFrame, on: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(on, median): the value at which half the weight (of rows: 1 each) is reached, the mean of two where it is met exactly.

    Weights of a value are added up first, running sums go by parts, so that no task holds the values of a key.
    """
    kept = df.where(F.col(value).isNotNull() if weight is None else (F.col(weight) > 0) & F.col(value).isNotNull())
    g = running(kept.groupBy(*on, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("w")), on, value, ["w"])
    low, high = F.min(F.when(F.col("c_w") >= F.col("t_w") / 2, F.col(value))), F.min(F.when(F.col("c_w") > F.col("t_w") / 2, F.col(value)))
    return g.groupBy(*on).agg(((low + F.coalesce(high, low)) / 2).alias("median"))


def robust_sd(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """Per key median and 1.4826 times the median absolute deviation."""
    off = joined(df, medians(df, on, value), on).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    counts = off.groupBy(*on).agg(F.first("median").alias("median"), F.count(value).alias("n"))
    mad = medians(off, on, "__d").select(*on, (1.4826 * F.col("median")).alias("robust_sd"))
    return joined(counts, mad, on).select(*on, "median", "robust_sd", "n")


def weighted_median(df: DataFrame, on: list[str], value: str, weight: str) -> DataFrame:
    """Per key the weighted median; see ``medians``."""
    return medians(df, on, value, weight).withColumnRenamed("median", "weighted_median")


def smallest_mode(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """The most frequent value, the smallest of several."""
    g = df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("__n"))
    return g.groupBy(*on).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("b")).select(*on, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("n"))


def standardized(df: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``, the z-scores with the population's standard deviation: sums per key, joined back, no window."""
    g = df.groupBy(*on).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return joined(df, g, on, "left").withColumn(name, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def agreement(df: DataFrame, on: list[str], truth: str, est: str) -> DataFrame:
    """Pairs, r, bias, RMSE, slope through the origin, Nash-Sutcliffe efficiency, amplitude ratio; r is null for fewer than 3 pairs or no spread."""
    d = df.where(both(F.col(truth), F.col(est)))
    m = d.groupBy(*on).agg(F.avg(truth).alias("__m"))
    e = F.col(est) - F.col(truth)
    g = joined(d, m, on).groupBy(*on).agg(
        F.count("*").alias("n"), corr(truth, est).alias("__r"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(F.col(truth) * F.col(est)).alias("__te"), F.sum(F.col(truth) * F.col(truth)).alias("__tt"),
        F.sum(e * e).alias("__ee"), F.sum((F.col(truth) - F.col("__m")) * (F.col(truth) - F.col("__m"))).alias("__vv"), F.stddev_pop(truth).alias("__st"), F.stddev_pop(est).alias("__se"),
    )
    spread = (F.col("n") > 2) & (F.col("__st") > 0) & (F.col("__se") > 0)
    return g.select(*on, "n", F.when(spread, F.col("__r")).alias("r"), "bias", "rmse", F.try_divide("__te", "__tt").alias("slope_origin"), (1 - F.try_divide("__ee", "__vv")).alias("nse"), F.try_divide("__se", "__st").alias("amplitude_ratio"))


def autocorrelation(df: DataFrame, on: list[str], t: str, x: str, max_lag: int) -> DataFrame:
    """Mean product of standardised values by whole lag, up to ``max_lag``; lags are joined by equality."""
    z = standardized(df.where(F.col(x).isNotNull()), on, x, "__z").select(*on, F.col(t).alias("__t"), "__z")
    a = z.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("__u", F.col("__t") + F.col("lag"))
    b = z.select(*on, F.col("__t").alias("__u"), F.col("__z").alias("__y"))
    return a.join(b, [*on, "__u"]).groupBy(*on, "lag").agg(F.avg(F.col("__z") * F.col("__y")).alias("rho"), F.count("*").alias("n"))
