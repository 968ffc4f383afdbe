"""Pairs of acquisitions: networks, range self-joins, exceedance, bridges, connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_pairs(dates: DataFrame, on: list[str], date: str, max_days: int, most: int | None = None) -> DataFrame:
    """Small-baseline network: pairs of distinct dates at most ``max_days`` apart, at most ``most`` forward pairs per date.

    Dates are laid into buckets of ``max_days``, so a date meets only its own and the next bucket.
    """
    d = dates.select(*on, F.col(date).cast("date").alias("t1")).dropna().distinct()
    bucket = lambda c: F.expr(f"(unix_date({c}) - pmod(unix_date({c}), {max_days})) div {max_days}")
    a = d.withColumn("__b", F.explode(F.array(bucket("t1"), bucket("t1") + 1)))
    b = d.select(*on, F.col("t1").alias("t2")).withColumn("__b", bucket("t2"))
    p = a.join(b, [*on, "__b"]).where((F.col("t2") > F.col("t1")) & (F.datediff("t2", "t1") <= max_days)).drop("__b")
    if most is not None:
        p = p.withColumn("__n", F.row_number().over(Window.partitionBy(*on, "t1").orderBy("t2"))).where(F.col("__n") <= most).drop("__n")
    return p.withColumn("days", F.datediff("t2", "t1"))


def consecutive_pairs(dates: DataFrame, on: list[str], date: str) -> DataFrame:
    """Each distinct date with the next."""
    d = dates.select(*on, F.col(date).cast("date").alias("t1")).dropna().distinct()
    return d.withColumn("t2", F.lead("t1").over(Window.partitionBy(*on).orderBy("t1"))).where("t2 IS NOT NULL")


def pair_changes(levels: DataFrame, on: list[str], date: str, level: str, max_days: int, barred: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """All pairs (t1, t2) of a key within ``max_days`` with lag and change; ``barred(t1, t2)`` leaves pairs out."""
    rows = levels.where(F.col(level).isNotNull()).select(*on, F.col(date).cast("date").alias("d"), F.col(level).alias("v"))
    bucket = F.expr(f"(unix_date(d) - pmod(unix_date(d), {max_days})) div {max_days}")
    a = rows.withColumn("__b", F.explode(F.array(bucket, bucket + 1))).select(*on, "__b", F.col("d").alias("t1"), F.col("v").alias("v1"))
    b = rows.withColumn("__b", bucket).select(*on, "__b", F.col("d").alias("t2"), F.col("v").alias("v2"))
    p = a.join(b, [*on, "__b"]).where((F.col("t2") > F.col("t1")) & (F.datediff("t2", "t1") <= max_days))
    if barred is not None:
        p = p.where(~barred(F.col("t1"), F.col("t2")))
    return p.select(*on, "t1", "t2", F.datediff("t2", "t1").alias("lag"), (F.col("v2") - F.col("v1")).alias("change"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a proportion; null for n = 0."""
    n = F.when(n > 0, n)
    p = k / n
    middle, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (middle - spread) / scale, (middle + spread) / scale


def exceedance(changes: DataFrame, threshold: float, edges: list[int]) -> DataFrame:
    """Share of changes beyond ``threshold`` by half-open lag bin, with its Wilson interval and the median change."""
    lower = F.lit(None).cast("int")
    for a, b in zip(edges, edges[1:], strict=False):
        lower = F.when((F.col("lag") >= a) & (F.col("lag") < b), a).otherwise(lower)
    g = changes.withColumn("lag_from", lower).where("lag_from IS NOT NULL").groupBy("lag_from").agg(F.count("*").alias("n"), F.count_if(F.abs("change") > threshold).alias("k"), F.median(F.abs("change")).alias("median_change"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.withColumns({"share": F.col("k") / F.col("n"), "low": low, "high": high})


def quarter_picks(pairs: DataFrame, n: int) -> DataFrame:
    """The shortest pair of every quarter, thinned to ``n`` evenly spaced quarters."""
    best = pairs.withColumn("__q", F.date_trunc("quarter", "t1")).withColumn("__k", F.row_number().over(Window.partitionBy("__q").orderBy("days", "t1", "t2"))).where("__k = 1")
    w = Window.partitionBy()
    ranked = best.withColumns({"__r": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__q")) - 1, "__m": F.count("*").over(w)})
    step = (F.col("__m") - 1) / F.lit(max(1, n - 1))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.rint(k * step).cast("int"))
    return ranked.where((F.col("__m") <= n) | F.array_contains(wanted, F.col("__r").cast("int"))).drop("__q", "__k", "__r", "__m")


def all_dates(a: DataFrame, b: DataFrame, on: list[str], dates: list[str], offset: float, tolerance: float, key: int) -> DataFrame:
    """Rows of a with the row of b of the same ``on`` of which every date lies ``offset`` days (within ``tolerance``) later, one to one.

    Every row of a (told apart by its first ``key`` dates) keeps its first partner, then every partner its first row, in order of their
    dates. Dates are numbers of days. Rows of b lie in buckets of twice the tolerance by their first date, so a row of a meets two buckets only.
    """
    width = 2.0 * tolerance
    bucket = lambda c: F.floor(c / width).cast("long")
    keys = [f"__k{i}" for i in range(len(on))]
    named = lambda df, side: df.select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), *(F.col(t).alias(f"{side}{n}") for n, t in enumerate(dates)))
    left = named(a, "a").withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("a0") + offset - tolerance), bucket(F.col("a0") + offset + tolerance)))))
    m = left.join(named(b, "b").withColumn("__b", bucket(F.col("b0"))), [*keys, "__b"])
    for n in range(len(dates)):
        m = m.where(F.abs(F.col(f"b{n}") - F.col(f"a{n}") - offset) <= tolerance + 1e-9)
    of = lambda side, n: [f"{side}{k}" for k in range(n)]
    for own, other in (("a", "b"), ("b", "a")):
        order = [*of(other, len(dates)), *of(own, len(dates))]
        m = m.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, *of(own, key)).orderBy(*order))).where("__n = 1").drop("__n")
    return m.select(*(F.col(k).alias(c) for c, k in zip(on, keys, strict=True)), *(F.col(f"{x}{n}").alias(f"{x}_{t}") for x in "ab" for n, t in enumerate(dates)))


def both_ends(a: DataFrame, b: DataFrame, on: list[str], t1: str, t2: str, offset: float, tolerance: float) -> DataFrame:
    """Pairs of a with the pair of b that lies ``offset`` days (within ``tolerance``) later at both ends, one to one; see ``all_dates``."""
    return all_dates(a, b, on, [t1, t2], offset, tolerance, 2)


def bridged_gaps(pairs: DataFrame, on: list[str], t1: str, t2: str, ok: Column) -> DataFrame:
    """(on, t1, t2, bridged): every gap between successive dates, and whether a pair that is ``ok`` spans it.

    Pairs open and close at their dates, so that a running sum tells how many span a gap; no gap meets a pair.
    """
    one = F.coalesce(ok, F.lit(False)).cast("int")
    ends = pairs.where(F.col(t1).isNotNull() & F.col(t2).isNotNull()).select(*on, F.explode(F.array(F.struct(F.col(t1).alias("t"), one.alias("x")), F.struct(F.col(t2).alias("t"), (-one).alias("x")))).alias("e")).select(*on, "e.*")
    w = Window.partitionBy(*on).orderBy("t")
    dates = ends.groupBy(*on, "t").agg(F.sum("x").alias("x")).withColumns({"t2": F.lead("t").over(w), "__open": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return dates.where("t2 IS NOT NULL").select(*on, F.col("t").alias("t1"), "t2", (F.col("__open") > 0).alias("bridged"))


def none_between(pairs: DataFrame, dates: DataFrame, on: list[str], t1: str, t2: str, date: str) -> DataFrame:
    """The pairs of which no date of the same ``on`` lies strictly between both ends (an anti join by range): the first date after t1 is not before t2."""
    keys = [f"__k{i}" for i in range(len(on))]
    key = [F.col(c).alias(k) for c, k in zip(on, keys, strict=True)]
    d = dates.select(*key, F.col(date).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(pairs.select(F.struct(*pairs.columns)).schema[0].dataType).alias("__p")).where("__t IS NOT NULL")
    p = pairs.select(*key, F.col(t1).alias("__t"), F.lit(1).alias("__side"), F.struct(*pairs.columns).alias("__p"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(1, Window.unboundedFollowing)
    after = d.unionByName(p).withColumn("__next", F.first(F.when(F.col("__side") == 0, F.col("__t")), ignorenulls=True).over(w)).where("__side = 1")
    return after.where(F.col("__next").isNull() | (F.col("__next") >= F.col(f"__p.{t2}"))).select("__p.*")


def components(edges: DataFrame, a: str, b: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component): the smallest node that each node is connected with, by alternating large-star and small-star rounds.

    Every round writes its links through ``keep``; they end when nothing changes, after a number of rounds that grows with the logarithm of the nodes.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    links = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = keep(small)
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            break
        links = new
    return nodes.join(links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def bridges(dates: DataFrame, node: str, component: str, existing: DataFrame, max_days: int, most: int) -> DataFrame:
    """The shortest new pairs between different components, at most ``most`` for each two of them."""
    d = dates.select(F.col(node).cast("date").alias("d"), F.col(component).alias("c"))
    bucket = F.expr(f"(unix_date(d) - pmod(unix_date(d), {max_days})) div {max_days}")
    a = d.withColumn("__b", F.explode(F.array(bucket, bucket + 1))).select("__b", F.col("d").alias("t1"), F.col("c").alias("c1"))
    b = d.withColumn("__b", bucket).select("__b", F.col("d").alias("t2"), F.col("c").alias("c2"))
    p = a.join(b, "__b").where((F.col("t2") > F.col("t1")) & (F.datediff("t2", "t1") <= max_days) & (F.col("c1") != F.col("c2"))).drop("__b")
    p = p.join(existing.select("t1", "t2"), ["t1", "t2"], "left_anti").withColumn("days", F.datediff("t2", "t1"))
    w = Window.partitionBy(F.least("c1", "c2"), F.greatest("c1", "c2")).orderBy("days", "t1", "t2")
    return p.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def design(pairs: DataFrame, on: list[str], t1: str, t2: str) -> DataFrame:
    """Which increments between successive dates a pair spans: triples (t1, t2, inc) with ``inc`` the increment's number from 0."""
    dates = pairs.select(*on, F.col(t1).alias("d")).unionByName(pairs.select(*on, F.col(t2).alias("d"))).distinct()
    number = dates.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy("d")) - 1)
    p = pairs.join(number.select(*on, F.col("d").alias(t1), F.col("k").alias("__i")), [*on, t1]).join(number.select(*on, F.col("d").alias(t2), F.col("k").alias("__j")), [*on, t2])
    return p.where("__j > __i").withColumn("inc", F.explode(F.sequence(F.col("__i"), F.col("__j") - 1))).drop("__i", "__j")


def nearest_per_year(dates: DataFrame, date: str, month: int, day: int, window_days: int | None = None) -> DataFrame:
    """(year, date, gap): each year's dates by distance to a day of the year; the nearest only, or all within ``window_days``."""
    d = dates.select(F.col(date).cast("date").alias("date")).dropna().distinct().withColumn("year", F.year("date"))
    d = d.withColumn("gap", F.abs(F.datediff("date", F.make_date("year", F.lit(month), F.lit(day)))))
    if window_days is not None:
        return d.where(F.col("gap") <= window_days)
    return d.withColumn("__n", F.row_number().over(Window.partitionBy("year").orderBy("gap", "date"))).where("__n = 1").drop("__n")


def top_transitions(scored: DataFrame, year: str, date: str, score: str, max_gap_years: int, k: int) -> DataFrame:
    """The k best pairs (smallest summed score) for every two years at most ``max_gap_years`` apart."""
    a = scored.select(F.col(year).alias("y1"), F.col(date).alias("t1"), F.col(score).alias("s1"))
    b = scored.select(F.col(year).alias("y2"), F.col(date).alias("t2"), F.col(score).alias("s2"))
    a = a.withColumn("y2", F.explode(F.sequence(F.col("y1") + 1, F.col("y1") + max_gap_years)))
    p = a.join(b, "y2").withColumn("score", F.col("s1") + F.col("s2"))
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("y1", "y2").orderBy("score", "t1", "t2"))).where(F.col("rank") <= k)
