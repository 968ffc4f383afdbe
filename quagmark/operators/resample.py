"""Resampling: all circular shifts, permutations, block bootstrap as weights, jackknife by date.

Draws are a hash of (seed, draw, block), so any engine and any partitioning gives the same ones.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quagmark.operators.stats import corr, joined
from quagmark.session import checkpointed


def shift_null(df: DataFrame, on: list[str], order: str, x: str, y: str, min_shift: int = 3) -> DataFrame:
    """Per key r, and the share of all circular shifts whose r is at least as large: (n, r, shifts, p).

    All shifts' products come from one Fourier transform of a key's series (n log n, where pairs of rows would be n squared); a task holds one series.
    """
    known = df.dropna(subset=[x, y]).select(*on, F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("s"))
    series = known.groupBy(*on).agg(F.array_sort(F.collect_list("s")).alias("s")).select(*on, F.transform("s", lambda e: e["x"]).alias("__x"), F.transform("s", lambda e: e["y"]).alias("__y"))

    @F.pandas_udf("struct<n:long,r:double,shifts:long,p:double>")
    def shifted(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(xs, ys, strict=True):
            a, b = np.asarray(a, float), np.asarray(b, float)
            n = len(a)
            a, b = a - a.mean(), b - b.mean()
            spread = np.sqrt((a * a).sum() * (b * b).sum())
            if not spread > 0:
                out.append((n, None, max(0, n - 2 * min_shift + 1), None))
                continue
            r = np.fft.irfft(np.conj(np.fft.rfft(a)) * np.fft.rfft(b), n) / spread if n > 1 else np.array([1.0])
            others = np.abs(r[min_shift : n - min_shift + 1])
            out.append((n, r[0], len(others), ((others >= abs(r[0]) - 1e-12).sum() + 1) / (len(others) + 1)))
        return pd.DataFrame(out, columns=["n", "r", "shifts", "p"]).astype({"r": float, "p": float})

    return series.where(F.size("__x") > 0).select(*on, shifted("__x", "__y").alias("t")).select(*on, "t.*")


def all_permutations(spark: SparkSession, n: int) -> DataFrame:
    """(perm, i, j): every permutation of 0..n-1, for n up to 9."""
    if n > 9:
        raise ValueError("permutations are enumerated for at most 9 values")
    return spark.createDataFrame([(k, list(p)) for k, p in enumerate(permutations(range(n)))], "perm int, p array<int>").select("perm", F.posexplode("p").alias("i", "j"))


def spearman_exact(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho of at most 9 pairs and its exact two-sided p over all permutations."""
    from quagmark.operators.stats import average_rank

    d = df.dropna(subset=[x, y]).withColumns({"__rx": average_rank([], x), "__ry": average_rank([], y)}).withColumn("i", F.row_number().over(Window.orderBy("__rx", "__ry")) - 1)
    rows = d.select("i", "__rx", "__ry").limit(10).collect()
    perms = all_permutations(df.sparkSession, len(rows))
    a = perms.join(d.select("i", "__rx"), "i").join(d.select(F.col("i").alias("j"), "__ry"), "j").groupBy("perm").agg(corr("__rx", "__ry").alias("r"))
    own = F.max(F.when(F.col("perm") == 0, F.abs("r"))).over(Window.partitionBy())
    return a.withColumn("__o", own).agg(F.max(F.when(F.col("perm") == 0, F.col("r"))).alias("rho"), F.avg((F.abs("r") >= F.col("__o") - 1e-12).cast("double")).alias("p"))


def uniform(seed: int, *parts: Column) -> Column:
    """A whole number in [0, 2**32) by the first half of md5 of seed and parts, joined by '-', which every SQL engine can repeat."""
    text = F.concat_ws("-", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw(seed: int, number: Column, slot: Column, n: Column) -> Column:
    """A whole number in [0, n), as good as even for n far below 2**32."""
    return F.pmod(uniform(seed, number, slot), n)


def block_weights(blocks: DataFrame, block: str, n_draws: int, seed: int = 0) -> DataFrame:
    """(draw, block, w): how often each block is drawn with replacement; every draw has as many as there are blocks."""
    w = Window.partitionBy()
    b = blocks.select(block).distinct().withColumns({"__k": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(block)) - 1, "__n": F.count("*").over(w)})
    d = b.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("__pick", draw(seed, F.col("draw"), F.col("__k"), F.col("__n")))
    return d.groupBy("draw", "__pick").agg(F.count("*").alias("w")).join(b.select(F.col("__k").alias("__pick"), block), "__pick").select("draw", block, "w")


def bootstrap_mean(df: DataFrame, block: str, value: str, n_draws: int, seed: int = 0) -> DataFrame:
    """Per draw the mean of ``value`` over the drawn blocks: block sums are made once and weighted, rows are not read again."""
    sums = df.where(F.col(value).isNotNull()).groupBy(block).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    w = block_weights(sums, block, n_draws, seed)
    return w.join(sums, block).groupBy("draw").agg((F.sum(F.col("w") * F.col("__s")) / F.sum(F.col("w") * F.col("__n"))).alias("mean"))


def interval(draws: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return draws.agg(F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"), F.count(value).alias("n"))


def date_jackknife(pairs: DataFrame, t1: str, t2: str, value: str) -> DataFrame:
    """Per date the mean of ``value`` without the pairs that touch it: totals minus own sums."""
    total = F.struct(F.sum(value).alias("s"), F.count(value).alias("n"))
    own = pairs.select(F.explode(F.array_distinct(F.array(t1, t2))).alias("date"), F.col(value).alias("v")).groupBy("date").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    whole = pairs.agg(total.alias("t"))
    return own.join(whole, how="cross").select("date", F.try_divide(F.col("t.s") - F.col("s"), F.col("t.n") - F.col("n")).alias("mean_without"))


def permuted_within(df: DataFrame, on: list[str], rec_id: str, x: str, n_draws: int, seed: int = 0) -> DataFrame:
    """``df`` once per draw (``draw``), with x exchanged among the rows of the same ``on``, in an order by the hash of draw and id (which must be unique)."""
    d = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    place = Window.partitionBy("draw", *on)
    d = d.withColumns({"__i": F.row_number().over(place.orderBy(rec_id)), "__j": F.row_number().over(place.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("draw").cast("string"), F.col(rec_id).cast("string"))), rec_id))})
    other = d.select("draw", *on, F.col("__j").alias("__i"), F.col(x).alias(f"{x}_permuted"))
    return d.drop("__j").join(other, ["draw", *on, "__i"]).drop("__i")


def matched_zones(cells: DataFrame, row: str, col: str, n_target: int, n_reference: int, n_trials: int, seed: int = 0) -> DataFrame:
    """(trial, row, col, zone): per trial two adjacent compact patches of ``cells`` of exactly the sizes wanted.

    Around a drawn cell the nearest cells make one patch, which a line in a drawn direction cuts in two (``target`` and
    ``reference``); ties go by row and column. With fewer cells than wanted there are no trials.

    The drawn cells go to all cells as one row. Rings around them, each about twice as large as all within it, are counted, and only
    cells of the rings that a patch reaches are sorted, so that no task holds the cells of a trial and they are not broadcast.
    """
    need = n_target + n_reference
    c = checkpointed(cells.select(row, col).dropna().distinct())
    # a trial's seed is the cell whose hash with the trial is least: a partial minimum, no cell is moved
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("trial").cast("string"), F.col(row).cast("string"), F.col(col).cast("string")))
    every = c.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1))))
    seeds = every.groupBy("trial").agg(F.min(F.struct(key.alias("key"), F.col(row).alias("r"), F.col(col).alias("c"))).alias("s"), F.count("*").alias("__n")).where(F.col("__n") >= need)
    angle = uniform(seed, F.col("trial")) / float(1 << 32) * math.pi
    seeds = checkpointed(seeds.select("trial", F.col("s.r").alias("__r"), F.col("s.c").alias("__c"), angle.alias("__angle")))
    # squares of whole numbers in 64 bits
    wide = lambda k, of: F.col(k).cast("long") if isinstance(cells.schema[of].dataType, T.IntegralType) else F.col(k)
    dr, dc = wide(row, row) - wide("__r", row), wide(col, col) - wide("__c", col)

    def around(seeds: DataFrame) -> DataFrame:
        each = joined(c, seeds.agg(F.collect_list(F.struct(*seeds.columns)).alias("__s")), []).select(row, col, F.explode("__s").alias("__s")).select(row, col, "__s.*")
        return each.withColumn("__d2", dr * dr + dc * dc).withColumn("__ring", F.floor(F.log2(F.col("__d2") + 1)))

    within = Window.partitionBy("trial").orderBy("__ring").rowsBetween(Window.unboundedPreceding, -1)
    rings = around(seeds).groupBy("trial", "__ring").agg(F.count("*").alias("__n")).withColumn("__within", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    reach = rings.where(F.col("__within") < need).groupBy("trial").agg(F.max("__ring").alias("__reach"))
    w = Window.partitionBy("trial")
    near = around(seeds.join(reach, "trial")).where("__ring <= __reach")
    patch = near.withColumn("__k", F.row_number().over(w.orderBy("__d2", row, col))).where(F.col("__k") <= need)
    along = F.round(F.col(row) * F.cos("__angle") + F.col(col) * F.sin("__angle"), 6)
    half = patch.withColumn("__k", F.row_number().over(w.orderBy(along, row, col)))
    return half.select("trial", row, col, F.when(F.col("__k") <= n_target, F.lit("target")).otherwise(F.lit("reference")).alias("zone"))


def normal_draws(seed: int, number: Column, slot: str) -> tuple[Column, Column]:
    """Two independent standard normal numbers (Box and Muller) of a draw."""
    u = (uniform(seed, number, F.lit(f"{slot}a")) + 0.5) / float(1 << 32)
    v = uniform(seed, number, F.lit(f"{slot}b")) / float(1 << 32) * (2 * math.pi)
    r = F.sqrt(-2 * F.log(u))
    return r * F.cos(v), r * F.sin(v)


def two_sight_amplitudes(fits: DataFrame, on: list[str], sights: tuple[tuple[float, float], tuple[float, float]], n_draws: int = 5000, seed: int = 0) -> DataFrame:
    """Per key the seasonal amplitudes east and up, with the spread that the fits' covariance gives them by Monte Carlo.

    ``fits``: per key the cosine and sine parts seen along two lines of sight and their covariance: a_cos, a_sin, a_cc, a_ss, a_cs and the
    same for b. ``sights``: (east, up) of both lines. Columns: direction, median, mean, sd, low, high (95 %).
    """
    (ea, ua), (eb, ub) = sights
    det = ea * ub - eb * ua
    d = fits.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))
    parts = {}
    for k in "ab":
        x, y = normal_draws(seed, F.col("__d"), k)
        l11 = F.sqrt(F.col(f"{k}_cc"))
        l21 = F.col(f"{k}_cs") / l11
        l22 = F.sqrt(F.greatest(F.col(f"{k}_ss") - l21 * l21, F.lit(0.0)))
        parts[k] = (F.col(f"{k}_cos") + l11 * x, F.col(f"{k}_sin") + l21 * x + l22 * y)
    east = [(ub * parts["a"][i] - ua * parts["b"][i]) / det for i in (0, 1)]
    up = [(ea * parts["b"][i] - eb * parts["a"][i]) / det for i in (0, 1)]
    both = d.select(*on, F.explode(F.array(F.struct(F.lit("east").alias("direction"), F.hypot(*east).alias("v")), F.struct(F.lit("up").alias("direction"), F.hypot(*up).alias("v")))).alias("x")).select(*on, "x.*")
    return both.groupBy(*on, "direction").agg(F.median("v").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def empirical_p(null: DataFrame, on: list[str], value: str, observed: str) -> DataFrame:
    """(1 + nulls at least as large) / (1 + nulls)."""
    return null.groupBy(*on).agg(((1 + F.count_if(F.col(value) >= F.col(observed))) / (1 + F.count(value))).alias("p"), F.count(value).alias("n"))


def nearest_matches(treated: DataFrame, control: DataFrame, rec_id: str, on: str, caliper: float, order: str | None = None, tie: str | None = None) -> DataFrame:
    """Greedy nearest matching without replacement: (treated, control, distance).

    Treated rows choose in ``order`` (else their id), then id; each takes the free control nearest in ``on`` within the caliper, of
    equally near ones that nearest in ``tie``, then the smallest id. Rows without a number or an id take no part. Matching is sequential,
    but where values leave a gap of more than the caliper no match can cross, so the stretches between gaps are matched apart.
    A task holds one stretch, sorted, and finds each nearest by bisection.
    """
    side = lambda df, k: df.select(F.lit(k).alias("side"), F.col(rec_id).alias("id"), F.col(on).cast("double").alias("x"), (F.col(order) if order and k == 0 else F.col(rec_id)).alias("o") if k == 0 else F.lit(None).alias("o"), (F.col(tie).cast("double") if tie else F.lit(0.0)).alias("z"))
    t = side(treated, 0)
    both = t.unionByName(side(control, 1).withColumn("o", F.lit(None).cast(t.schema["o"].dataType))).where("x IS NOT NULL AND id IS NOT NULL AND NOT isnan(x)")
    width = max(caliper, 1e-300)
    # values a caliper or less apart lie in the same or in neighbouring buckets; the window has a row per occupied bucket
    both = both.withColumn("b", F.floor(F.col("x") / width))
    w = Window.orderBy("b")
    buckets = both.select("b").distinct().withColumn("new", (F.col("b") - F.lag("b").over(w) > 1).cast("int")).withColumn("stretch", F.coalesce(F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    placed = both.join(buckets.select("b", "stretch"), "b").drop("b")
    kind = treated.schema[rec_id].dataType.simpleString()

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        free = sorted(pdf[pdf.side == 1][["x", "id", "z"]].itertuples(index=False, name=None))
        xs = [f[0] for f in free]
        out = []
        for i, x, z in pdf[pdf.side == 0].sort_values(["o", "id"])[["id", "x", "z"]].itertuples(index=False, name=None):
            k = bisect_left(xs, x)
            near = [abs(xs[n] - x) for n in (k - 1, k) if 0 <= n < len(xs)]
            if not near or min(near) > caliper:
                continue
            best = None
            for value in {v for n in (k - 1, k) if 0 <= n < len(xs) and abs((v := xs[n]) - x) == min(near)}:
                for n in range(bisect_left(xs, value), bisect_right(xs, value)):
                    key = (abs(free[n][2] - z), free[n][1], n)
                    best = key if best is None or key < best else best
            n = best[2]
            out.append((i, free[n][1], abs(xs[n] - x)))
            del free[n], xs[n]
        return pd.DataFrame(out, columns=["treated", "control", "distance"])

    return placed.groupBy("stretch").applyInPandas(match, f"treated {kind}, control {kind}, distance double")


def year_bootstrap(df: DataFrame, year: str, statistic: Callable[[DataFrame], DataFrame], n_draws: int, seed: int = 0) -> DataFrame:
    """The draws of any statistic under resampling of whole years: (draw, and what ``statistic`` gives).

    ``statistic`` takes rows with the column ``draw`` and gives a row per draw (a grouped aggregate); a year drawn twice counts twice.
    """
    w = block_weights(df.where(F.col(year).isNotNull()), year, n_draws, seed)
    copies = w.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).select("draw", F.col(year).alias("__y"))
    return statistic(copies.join(df, F.col("__y") == df[year]).drop("__y"))
