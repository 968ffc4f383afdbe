"""Grids in long form: cells, regridding, neighbourhoods, zones, distances, relocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quagmark.operators.circular import phasor, phasor_sums


def cell(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the cell in which a coordinate lies, cells being centred at first + k * step (step may be negative); null outside."""
    k = F.floor((x - (first - step / 2)) / step)
    return F.when((k >= 0) & (k < n), k.cast("int"))


def regrid(fine: DataFrame, on: list[str], row: str, col: str, value: str, min_count: int = 1) -> DataFrame:
    """Per coarse cell the mean, the sample standard deviation and the share of valid fine pixels; the mean is null below ``min_count``."""
    g = fine.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*on, row, col).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), (F.count(value) / F.count("*")).alias("valid"))
    return g.withColumn("mean", F.when(F.col("n") >= min_count, F.col("mean")))


def regrid_phase(fine: DataFrame, on: list[str], row: str, col: str, phase: str, min_count: int = 1) -> DataFrame:
    """Per coarse cell the circular mean of the fine pixels' phase."""
    g = fine.where(F.col(phase).isNotNull()).groupBy(*on, row, col).agg(*phasor_sums(F.col(phase), F.lit(1.0)), F.count("*").alias("n"))
    mean, r = phasor(F.col("s"), F.col("c"), F.col("w"))
    return g.where(F.col("n") >= min_count).select(*on, row, col, mean.alias("phase"), r.alias("r"), "n")


def class_fractions(fine: DataFrame, on: list[str], row: str, col: str, classes: str, codes: list) -> DataFrame:
    """Per coarse cell the share of each class code among its pixels."""
    return fine.groupBy(*on, row, col).agg(*(F.avg(F.when(F.col(classes) == k, 1.0).otherwise(0.0)).alias(f"share_{k}") for k in codes))


def around(grid: DataFrame, row: str, col: str, half: int) -> DataFrame:
    """Every pixel once for each pixel of whose (2 half + 1) squared window it is part: an equi-join's side, not a range join."""
    off = F.sequence(F.lit(-half), F.lit(half))
    return grid.withColumn("__dr", F.explode(off)).withColumn("__dc", F.explode(off)).withColumns({row: F.col(row) + F.col("__dr"), col: F.col(col) + F.col("__dc")})


def window_stats(grid: DataFrame, on: list[str], row: str, col: str, value: str, half: int = 1) -> DataFrame:
    """Per pixel the median, mean, sample deviation, interquartile range and count of its window, clipped at the edges."""
    spread = around(grid.select(*on, row, col, value), row, col, half)
    g = spread.groupBy(*on, row, col).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.percentile(value, 0.75) - F.percentile(value, 0.25)).alias("iqr"), F.count(value).alias("n"))
    return grid.select(*on, row, col).join(g, [*on, row, col])


def dilated(mask: DataFrame, row: str, col: str, distance: int) -> DataFrame:
    """The pixels at most ``distance`` steps (up, down, left, right) from a pixel of the mask."""
    near = around(mask.select(row, col), row, col, distance)
    return near.where(F.abs("__dr") + F.abs("__dc") <= distance).select(row, col).distinct()


def laplacian(mask: DataFrame, row: str, col: str) -> DataFrame:
    """The 4-neighbour Laplacian of the mask's pixels as triples (row, col, row2, col2, value)."""
    m = mask.select(row, col).distinct()
    near = around(m.select(row, col, F.col(row).alias("row2"), F.col(col).alias("col2")), row, col, 1).where(F.abs("__dr") + F.abs("__dc") == 1)
    edges = near.join(m, [row, col]).select(row, col, "row2", "col2", F.lit(-1.0).alias("value"))
    return edges.unionByName(edges.groupBy(row, col).agg(F.count("*").cast("double").alias("value")).select(row, col, F.col(row).alias("row2"), F.col(col).alias("col2"), "value"))


def zonal(df: DataFrame, on: list[str], zone: str, value: str) -> DataFrame:
    """Per zone n, mean, median, p10 and p90."""
    return df.where(F.col(value).isNotNull()).groupBy(*on, zone).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, 0.1).alias("p10"), F.percentile(value, 0.9).alias("p90"))


def profile(df: DataFrame, distance: str, value: str, edges: list[float], min_n: int = 4) -> DataFrame:
    """Mean and median by half-open distance bin."""
    k = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        k = F.when((F.col(distance) >= a) & (F.col(distance) < b), i).otherwise(k)
    g = df.where(F.col(value).isNotNull()).withColumn("bin", k).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"))
    return g.where(F.col("n") >= min_n)


def integral_image(grid: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Per pixel the sum and count over all pixels up and left of it, by two running sums."""
    along = Window.partitionBy(row).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(col).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    g = grid.select(row, col, F.coalesce(F.col(value), F.lit(0.0)).alias("__v"), F.col(value).isNotNull().cast("long").alias("__k"))
    g = g.withColumns({"__v": F.sum("__v").over(along), "__k": F.sum("__k").over(along)})
    return g.select(row, col, F.sum("__v").over(down).alias("total"), F.sum("__k").over(down).alias("count"))


def box_means(grid: DataFrame, row: str, col: str, value: str, half: int, min_cover: float = 0.9) -> DataFrame:
    """Per pixel the mean of the box of 2 half + 1 pixels a side, from four corners of the integral image; null below ``min_cover``. The grid must be full."""
    image = integral_image(grid, row, col, value)
    at = lambda dr, dc, n: image.select((F.col(row) - dr).alias(row), (F.col(col) - dc).alias(col), F.col("total").alias(f"t{n}"), F.col("count").alias(f"k{n}"))
    ends = grid.agg(F.max(row).alias("__mr"), F.max(col).alias("__mc"))
    p = grid.select(row, col).join(ends, how="cross")
    p = p.withColumns({"__r1": F.least(F.col(row) + half, "__mr"), "__c1": F.least(F.col(col) + half, "__mc"), "__r0": F.col(row) - half - 1, "__c0": F.col(col) - half - 1})
    for n, (r, c) in enumerate([("__r1", "__c1"), ("__r0", "__c1"), ("__r1", "__c0"), ("__r0", "__c0")]):
        corner = at(0, 0, n).withColumnsRenamed({row: r, col: c})
        p = p.join(corner, [r, c], "left")
    total = F.col("t0") - F.coalesce("t1", F.lit(0.0)) - F.coalesce("t2", F.lit(0.0)) + F.coalesce("t3", F.lit(0.0))
    count = F.col("k0") - F.coalesce("k1", F.lit(0)) - F.coalesce("k2", F.lit(0)) + F.coalesce("k3", F.lit(0))
    size = (2 * half + 1) ** 2
    return p.select(row, col, F.when(count >= min_cover * size, total / count).alias("box_mean"), count.alias("n"))


def relocated(grid: DataFrame, on: list[str], row: str, col: str, value: str, dr: float, dc: float, min_weight: float = 0.5) -> DataFrame:
    """The grid moved by a fraction of a pixel: bilinear weights over the valid ones of four pixels, null below ``min_weight``."""
    r0, c0 = int(dr // 1), int(dc // 1)
    fr, fc = dr - r0, dc - c0
    corners = [(a, b, (fr if a else 1 - fr) * (fc if b else 1 - fc)) for a in (0, 1) for b in (0, 1)]
    parts = F.array(*(F.struct(F.lit(-(r0 + a)).alias("a"), F.lit(-(c0 + b)).alias("b"), F.lit(float(w)).alias("w")) for a, b, w in corners if w > 0))
    spread = grid.select(*on, row, col, value, F.inline(parts)).withColumns({row: F.col(row) + F.col("a"), col: F.col(col) + F.col("b")})
    ok = F.col(value).isNotNull()
    g = spread.groupBy(*on, row, col).agg(F.sum(F.when(ok, F.col("w") * F.col(value))).alias("__s"), F.sum(F.when(ok, F.col("w")).otherwise(0.0)).alias("__w"))
    return grid.select(*on, row, col).join(g, [*on, row, col], "left").select(*on, row, col, F.when(F.col("__w") >= min_weight, F.col("__s") / F.col("__w")).alias("value"))


def spatial_block(row: Column, col: Column, block: int, n_cols: int) -> Column:
    """Number of the square block that a pixel lies in."""
    return F.floor(row / block) * -(-n_cols // block) + F.floor(col / block)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon (one ring), by counting the edges to its right."""
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def nearest_cells(mask: DataFrame, row: str, col: str, r0: int, c0: int, k: int) -> DataFrame:
    """The k pixels nearest to a place, ties by row and column."""
    return mask.withColumn("d2", (F.col(row) - r0) * (F.col(row) - r0) + (F.col(col) - c0) * (F.col(col) - c0)).orderBy("d2", row, col).limit(k)


def plane_residual(df: DataFrame, on: list[str], row: str, col: str, value: str, fit_on: Column, min_n: int = 10) -> DataFrame:
    """``df`` with ``residual`` from the plane fitted where ``fit_on`` holds."""
    from quagmark.operators.stats import fit

    one = F.lit(1.0) + 0 * F.col(row)
    f = fit(df.where(fit_on), on, [one, F.col(row).cast("double"), F.col(col).cast("double")], F.col(value), min_n).select(*on, F.col("b").alias("__b"))
    joined = df.join(f, on, "left") if on else df.join(f, how="cross")
    return joined.withColumn("residual", F.col(value) - F.col("__b")[0] - F.col("__b")[1] * F.col(row) - F.col("__b")[2] * F.col(col)).drop("__b")


def roughness(grid: DataFrame, on: list[str], row: str, col: str, value: str) -> DataFrame:
    """Median absolute difference of right and lower neighbours (edges do not wrap)."""
    g = grid.select(*on, row, col, F.col(value).alias("__v"))
    right = g.join(g.select(*on, row, (F.col(col) - 1).alias(col), F.col("__v").alias("__n")), [*on, row, col])
    down = g.join(g.select(*on, (F.col(row) - 1).alias(row), col, F.col("__v").alias("__n")), [*on, row, col])
    return right.unionByName(down).groupBy(*on).agg(F.median(F.abs(F.col("__v") - F.col("__n"))).alias("roughness"), F.count("*").alias("n"))


def shift_scores(a: DataFrame, b: DataFrame, row: str, col: str, x: str, y: str, reach: int, score) -> DataFrame:
    """(dr, dc, score, n): how well a's ``x`` agrees with b's ``y`` moved by every whole-cell shift up to ``reach``.

    ``score``: an aggregate of two columns. Cells meet by equality, each with one cell a shift; n counts the cells where both are known.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = a.select(row, col, F.col(x).alias("__x")).withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
    moved = moved.select((F.col(row) + F.col("dr")).alias("__r"), (F.col(col) + F.col("dc")).alias("__c"), "dr", "dc", "__x")
    other = b.select(F.col(row).alias("__r"), F.col(col).alias("__c"), F.col(y).alias("__y"))
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    return moved.join(other, ["__r", "__c"]).groupBy("dr", "dc").agg(score(F.col("__x"), F.col("__y")).alias("score"), F.count_if(both).alias("n"))


def best_shift(scores: DataFrame) -> DataFrame:
    """(dr, dc, score): the shift of the highest score, of several the one of the smallest dr, then dc; no row if no score is known."""
    known = scores.where(F.col("score").isNotNull())
    return known.agg(F.max(F.struct("score", (-F.col("dr")).alias("r"), (-F.col("dc")).alias("c"))).alias("b")).where("b IS NOT NULL").select((-F.col("b.r")).alias("dr"), (-F.col("b.c")).alias("dc"), F.col("b.score").alias("score"))
