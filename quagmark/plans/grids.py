"""Queries over grids, pair networks and per-group kernels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quagmark.operators import circular, kernels, pairs, spatial
from quagmark.plans.book import query, r6, rounded
from quagmark.plans.series import SERIES, scenes
from quagmark.session import checkpointed
from quagmark.sources.tables import table

#: The parts laid out as a grid of 50 columns.
WIDTH = 50


def grid(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / WIDTH).cast("int").alias("row"), (k % WIDTH).cast("int").alias("col"), F.when(F.col("p_size") > 3, F.col("p_retailprice")).alias("v"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


_GRID = "WITH g AS (SELECT CAST(p_partkey // 50 AS INTEGER) AS r, CAST(p_partkey % 50 AS INTEGER) AS c, CASE WHEN p_size > 3 THEN p_retailprice END AS v, p_size AS size, p_type AS kind FROM part)"


@query(f"{_GRID} SELECT r // 4 AS row, c // 4 AS col, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, count(v) AS n, round(count(v) / count(*), 6) AS valid FROM g GROUP BY 1, 2")
def regrid(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumns({"cr": spatial.cell(F.col("row") + 0.5, 2.0, 4.0, 10**6), "cc": spatial.cell(F.col("col") + 0.5, 2.0, 4.0, 10**6)})
    return spatial.regrid(g, [], "cr", "cc", "v").select(F.col("cr").alias("row"), F.col("cc").alias("col"), F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "n", r6(F.col("valid")).alias("valid"))


@query(f"{_GRID} SELECT r // 4 AS row, c // 4 AS col, round(atan2(avg(sin(v / 100)), avg(cos(v / 100))), 5) AS phase, round(sqrt(avg(sin(v / 100)) ** 2 + avg(cos(v / 100)) ** 2), 6) AS r, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY 1, 2")
def regrid_phase(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).select(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 4).cast("int").alias("col"), (F.col("v") / 100).alias("ph"))
    return rounded(spatial.regrid_phase(g, [], "row", "col", "ph").withColumn("phase", F.round("phase", 5)))


@query(f"{_GRID} SELECT r // 4 AS row, c // 4 AS col, round(avg(CASE WHEN size = 1 THEN 1.0 ELSE 0 END), 6) AS share_1, round(avg(CASE WHEN size = 7 THEN 1.0 ELSE 0 END), 6) AS share_7 FROM g GROUP BY 1, 2")
def class_fractions(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).select(F.floor(F.col("row") / 4).cast("int").alias("row"), F.floor(F.col("col") / 4).cast("int").alias("col"), "size")
    return rounded(spatial.class_fractions(g, [], "row", "col", "size", [1, 7]))


@query(f"""{_GRID} SELECT a.r AS row, a.c AS col, round(median(b.v), 5) AS median, round(avg(b.v), 5) AS mean, round(stddev_samp(b.v), 4) AS sd, round(quantile_cont(b.v, 0.75) - quantile_cont(b.v, 0.25), 4) AS iqr, count(b.v) AS n FROM g a JOIN g b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2""")
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    w = spatial.window_stats(grid(spark, d), [], "row", "col", "v")
    return w.select("row", "col", F.round("median", 5).alias("median"), F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"), F.round("iqr", 4).alias("iqr"), "n")


@query(f"{_GRID} SELECT kind, count(*) AS n, round(avg(v), 5) AS mean, round(median(v), 5) AS median, round(quantile_cont(v, 0.1), 5) AS p10, round(quantile_cont(v, 0.9), 5) AS p90 FROM g WHERE v IS NOT NULL GROUP BY 1")
def zonal(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.zonal(grid(spark, d), [], "kind", "v"), 5)


@query(f"""{_GRID}, x AS (SELECT sqrt((r - 2) ** 2 + (c - 25) ** 2) AS dist, v FROM g WHERE v IS NOT NULL), b AS (SELECT CASE WHEN dist < 5 THEN 0 WHEN dist < 10 THEN 1 WHEN dist < 20 THEN 2 WHEN dist < 40 THEN 3 END AS bin, v FROM x)
SELECT bin, count(*) AS n, round(avg(v), 5) AS mean, round(median(v), 5) AS median FROM b WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*) >= 4""")
def radial_profile(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("dist", F.sqrt(F.pow(F.col("row") - 2, 2) + F.pow(F.col("col") - 25, 2)))
    return rounded(spatial.profile(g, "dist", "v", [0, 5, 10, 20, 40]), 5)


@query(f"""{_GRID}, b AS (SELECT a.r, a.c, sum(b.v) AS s, count(b.v) AS n FROM g a JOIN g b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY 1, 2) SELECT r AS row, c AS col, round(CASE WHEN n >= 22.5 THEN s / n END, 4) AS box_mean, n FROM b""")
def box_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.box_means(grid(spark, d), "row", "col", "v", 2).withColumn("n", F.col("n").cast("long")), 4)


@query(f"""{_GRID}, p AS (SELECT r, c, v, 0.75 * 0.5 AS w FROM g UNION ALL SELECT r, c + 1, v, 0.75 * 0.5 FROM g UNION ALL SELECT r - 1, c, v, 0.25 * 0.5 FROM g UNION ALL SELECT r - 1, c + 1, v, 0.25 * 0.5 FROM g),
s AS (SELECT r, c, sum(w * v) AS s, sum(w) FILTER (v IS NOT NULL) AS w FROM p GROUP BY ALL) SELECT g.r AS row, g.c AS col, round(CASE WHEN s.w >= 0.5 THEN s.s / s.w END, 5) AS value FROM g LEFT JOIN s ON s.r = g.r AND s.c = g.c""")
def relocated(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.relocated(grid(spark, d), [], "row", "col", "v", 0.25, -0.5), 5)


@query(f"{_GRID} SELECT DISTINCT CAST(r + dr AS INTEGER) AS row, CAST(c + dc AS INTEGER) AS col FROM g, range(-2, 3) a(dr), range(-2, 3) b(dc) WHERE size = 1 AND abs(dr) + abs(dc) <= 2")
def dilated(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dilated(grid(spark, d).where("size = 1"), "row", "col", 2)


@query(f"""{_GRID}, m AS (SELECT r, c FROM g WHERE size > 10), e AS (SELECT a.r AS row, a.c AS col, b.r AS row2, b.c AS col2 FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1)
SELECT row, col, row2, col2, -1.0::DOUBLE AS value FROM e UNION ALL SELECT row, col, row, col, count(*)::DOUBLE FROM e GROUP BY row, col""")
def laplacian(spark: SparkSession, d: str) -> DataFrame:
    return spatial.laplacian(grid(spark, d).where("size > 10"), "row", "col")


@query(f"""{_GRID}, m AS (SELECT avg(r) AS mr, avg(c) AS mc, avg(v) AS mv, covar_pop(r, r) AS rr, covar_pop(r, c) AS rc, covar_pop(c, c) AS cc, covar_pop(r, v) AS rv, covar_pop(c, v) AS cv FROM g WHERE size > 10 AND v IS NOT NULL),
p AS (SELECT mr, mc, mv, (rv * cc - cv * rc) / (rr * cc - rc * rc) AS b, (cv * rr - rv * rc) / (rr * cc - rc * rc) AS a FROM m) SELECT r AS row, c AS col, round(v - mv - b * (r - mr) - a * (c - mc), 4) AS residual FROM g, p""")
def plane_residuals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.plane_residual(grid(spark, d), [], "row", "col", "v", F.col("size") > 10).select("row", "col", "residual"), 4)


@query(f"""{_GRID}, x AS (SELECT abs(a.v - b.v) AS dv FROM g a JOIN g b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)) SELECT round(median(dv), 5) AS roughness, count(*) AS n FROM x""")
def roughness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.roughness(grid(spark, d), [], "row", "col", "v"), 5)


@query(f"{_GRID} SELECT r AS row, c AS col, (r - 2) ** 2 + (c - 25) ** 2 AS d2 FROM g WHERE size = 7 ORDER BY d2, r, c LIMIT 8")
def nearest_cells(spark: SparkSession, d: str) -> DataFrame:
    return spatial.nearest_cells(grid(spark, d).where("size = 7"), "row", "col", 2, 25, 8).select("row", "col", F.col("d2").cast("double").alias("d2"))


@query(f"{_GRID} SELECT CAST((r // 10) * 5 + c // 10 AS BIGINT) AS block, count(*) AS n, round(sum(v), 4) AS total FROM g GROUP BY 1")
def spatial_blocks(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("block", spatial.spatial_block(F.col("row"), F.col("col"), 10, WIDTH).cast("long"))
    return rounded(g.groupBy("block").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4)


@query(f"{_GRID} SELECT r AS row, c AS col FROM g WHERE c > 9.5 AND c < 29.5 AND r > 0.5 AND c - 9.5 > (r - 0.5) * 2 AND r < 1000")
def in_polygon(spark: SparkSession, d: str) -> DataFrame:
    ring = [(9.5, 0.5), (29.5, 0.5), (29.5, 10.5)]
    return grid(spark, d).where(spatial.in_polygon(F.col("col"), F.col("row"), ring)).select("row", "col")


# pair networks


def order_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


_DATES = "WITH dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS t FROM orders)"
_NET = f"{_DATES}, net AS (SELECT a.t AS t1, b.t AS t2, CAST(b.t - a.t AS INTEGER) AS days FROM dd a JOIN dd b ON b.t > a.t AND b.t - a.t <= 48 QUALIFY row_number() OVER (PARTITION BY a.t ORDER BY b.t) <= 4)"


@query(f"{_NET} SELECT * FROM net")
def network_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.forward_pairs(order_dates(spark, d), [], "date", 48, 4).select("t1", "t2", "days")


@query("SELECT station, plot, track, t1, t2 FROM (SELECT station, plot, track, date AS t1, lead(date) OVER (PARTITION BY station, plot, track ORDER BY date) AS t2 FROM (SELECT DISTINCT station, plot, track, date FROM plots_acq)) WHERE t2 IS NOT NULL")
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.consecutive_pairs(table(spark, d, "plots_acq"), [*SERIES, "track"], "date")


@query("""WITH c AS (SELECT CAST(b.o_orderdate AS DATE) - CAST(a.o_orderdate AS DATE) AS lag, b.o_totalprice - a.o_totalprice AS ch FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) > CAST(a.o_orderdate AS DATE) AND CAST(b.o_orderdate AS DATE) - CAST(a.o_orderdate AS DATE) <= 120 WHERE NOT (month(a.o_orderdate) = 1 AND month(b.o_orderdate) = 2)),
g AS (SELECT CAST(CASE WHEN lag < 20 THEN 1 WHEN lag < 60 THEN 20 WHEN lag < 121 THEN 60 END AS INTEGER) AS lag_from, count(*) AS n, count(*) FILTER (abs(ch) > 150000) AS k, median(abs(ch)) AS m FROM c GROUP BY 1)
SELECT lag_from, n, k, round(m, 4) AS median_change, round(k / n, 6) AS share, round((k / n + 1.96 ** 2 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n), 6) AS low,
round((k / n + 1.96 ** 2 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 ** 2 / (4 * n * n))) / (1 + 1.96 ** 2 / n), 6) AS high FROM g""")
def exceedance(spark: SparkSession, d: str) -> DataFrame:
    barred = lambda a, b: (F.month(a) == 1) & (F.month(b) == 2)
    c = pairs.pair_changes(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_totalprice", 120, barred)
    e = pairs.exceedance(c, 150000, [1, 20, 60, 121])
    return e.select("lag_from", "n", "k", F.round("median_change", 4).alias("median_change"), *(r6(F.col(x)).alias(x) for x in ("share", "low", "high")))


@query(f"""{_NET}, q AS (SELECT *, date_trunc('quarter', t1) AS qq FROM net), b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY qq ORDER BY days, t1, t2) = 1), r AS (SELECT *, row_number() OVER (ORDER BY qq) - 1 AS r, count(*) OVER () AS m FROM b)
SELECT t1, t2, days FROM r WHERE m <= 12 OR r IN (SELECT CAST(round_even(k * (m - 1) / 11.0, 0) AS BIGINT) FROM range(0, 12) t(k))""")
def quarter_picks(spark: SparkSession, d: str) -> DataFrame:
    return pairs.quarter_picks(network_pairs(spark, d), 12)


def _series_links(spark: SparkSession, d: str) -> DataFrame:
    node = lambda c: F.concat_ws("|", *SERIES, "track", F.col(c).cast("string"))
    p = pairs.consecutive_pairs(table(spark, d, "plots_acq"), [*SERIES, "track"], "date")
    return p.where(F.datediff("t2", "t1") <= 12).select(node("t1").alias("a"), node("t2").alias("b"))


@query("""WITH p AS (SELECT DISTINCT station, plot, track, date FROM plots_acq), n AS (SELECT *, CASE WHEN date - lag(date) OVER w <= 12 THEN 0 ELSE 1 END AS nw, lead(date) OVER w - date AS ahead FROM p WINDOW w AS (PARTITION BY station, plot, track ORDER BY date)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY station, plot, track ORDER BY date) AS k FROM n), g AS (SELECT *, min(station || '|' || plot || '|' || track || '|' || CAST(date AS VARCHAR)) OVER (PARTITION BY station, plot, track, k) AS component, count(*) OVER (PARTITION BY station, plot, track, k) AS c FROM r)
SELECT station || '|' || plot || '|' || track || '|' || CAST(date AS VARCHAR) AS node, component FROM g WHERE c > 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return pairs.components(_series_links(spark, d), "a", "b", checkpointed)


@query("""WITH p AS (SELECT station || plot || track AS c, date AS t FROM plots_acq GROUP BY ALL), f AS (SELECT t, min(c) AS c FROM p GROUP BY 1), b AS (SELECT a.t AS t1, b.t AS t2, a.c AS c1, b.c AS c2, CAST(b.t - a.t AS INTEGER) AS days FROM f a JOIN f b ON b.t > a.t AND b.t - a.t <= 40 AND a.c <> b.c WHERE b.t - a.t > 2)
SELECT t1, t2, c1, c2, days FROM b QUALIFY row_number() OVER (PARTITION BY least(c1, c2), greatest(c1, c2) ORDER BY days, t1, t2) <= 3""")
def bridges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "plots_acq").groupBy("date").agg(F.min(F.concat("station", "plot", "track")).alias("c"))
    near = pairs.forward_pairs(p, [], "date", 2)
    return pairs.bridges(p, "date", "c", near, 40, 3).select("t1", "t2", "c1", "c2", "days")


@query(f"""{_NET}, x AS (SELECT t1 AS t FROM net UNION SELECT t2 FROM net), k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM x), j AS (SELECT a.k AS i, b.k AS j FROM net JOIN k a ON a.t = t1 JOIN k b ON b.t = t2)
SELECT CAST(inc AS INTEGER) AS inc, count(*) AS spans FROM (SELECT unnest(range(i, j)) AS inc FROM j) GROUP BY 1""")
def design_spans(spark: SparkSession, d: str) -> DataFrame:
    return pairs.design(network_pairs(spark, d), [], "t1", "t2").groupBy("inc").agg(F.count("*").alias("spans"))


@query(f"{_DATES} SELECT CAST(year(t) AS INTEGER) AS year, t AS date, CAST(abs(t - make_date(year(t), 4, 15)) AS INTEGER) AS gap FROM dd QUALIFY row_number() OVER (PARTITION BY year(t) ORDER BY abs(t - make_date(year(t), 4, 15)), t) = 1")
def april_dates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.nearest_per_year(order_dates(spark, d), "date", 4, 15).select("year", "date", "gap")


@query(f"""{_DATES}, c AS (SELECT CAST(year(t) AS INTEGER) AS y, t, CAST(abs(t - make_date(year(t), 4, 15)) AS INTEGER) AS s FROM dd WHERE abs(t - make_date(year(t), 4, 15)) <= 15)
SELECT a.y AS y1, b.y AS y2, a.t AS t1, b.t AS t2, a.s + b.s AS score, CAST(row_number() OVER (PARTITION BY a.y, b.y ORDER BY a.s + b.s, a.t, b.t) AS INTEGER) AS rank FROM c a JOIN c b ON b.y BETWEEN a.y + 1 AND a.y + 2 QUALIFY rank <= 3""")
def annual_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = pairs.nearest_per_year(order_dates(spark, d), "date", 4, 15, 15)
    return pairs.top_transitions(c, "year", "date", "gap", 2, 3).select("y1", "y2", "t1", "t2", "score", "rank")


def phase_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of plot products within 24 days with a phase that does not quite close."""
    s = scenes(spark, d).where("vv_db_3x3 IS NOT NULL").select(*SERIES, "track", "date", F.col("vv_db_3x3").alias("v"))
    key = [*SERIES, "track"]
    p = pairs.forward_pairs(s, key, "date", 24)
    j = p.join(s.withColumnsRenamed({"date": "t1", "v": "v1"}), [*key, "t1"]).join(s.withColumnsRenamed({"date": "t2", "v": "v2"}), [*key, "t2"])
    return j.withColumn("phase", circular.wrap(F.col("v2") - F.col("v1") + 0.001 * F.col("days") * F.col("days")))


@query("""WITH s AS (SELECT station, plot, track, date AS t, vv_db_3x3 AS v FROM plots_acq QUALIFY row_number() OVER (PARTITION BY station, plot, track, date ORDER BY plot_acq_id) = 1), k AS (SELECT * FROM s WHERE v IS NOT NULL AND NOT isnan(v)),
p AS (SELECT a.station, a.plot, a.track, a.t AS t1, b.t AS t2, b.v - a.v + 0.001 * (b.t - a.t) * (b.t - a.t) AS ph FROM k a JOIN k b ON a.station = b.station AND a.plot = b.plot AND a.track = b.track AND b.t > a.t AND b.t - a.t <= 24)
SELECT x.station, x.plot, x.track, x.t1 AS a, x.t2 AS b, y.t2 AS c, round(atan2(sin(x.ph + y.ph - z.ph), cos(x.ph + y.ph - z.ph)), 5) AS closure FROM p x JOIN p y ON y.station = x.station AND y.plot = x.plot AND y.track = x.track AND y.t1 = x.t2
JOIN p z ON z.station = x.station AND z.plot = x.plot AND z.track = x.track AND z.t1 = x.t1 AND z.t2 = y.t2""")
def triangles(spark: SparkSession, d: str) -> DataFrame:
    t = circular.triangles(phase_pairs(spark, d), [*SERIES, "track"], "t1", "t2", "phase", 24)
    return rounded(t.select(*SERIES, "track", "a", "b", "c", "closure"), 5)


# kernels per series


def _day_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = phase_pairs(spark, d)
    return p.select(F.concat_ws("|", *SERIES, "track").alias("px"), F.unix_date("t1").alias("i"), F.unix_date("t2").alias("j"), (F.col("v2") - F.col("v1")).alias("y"), "phase", (1 / (1 + F.col("days") / 24)).alias("coh"), F.lit(0.5).alias("sd"))


@query()
def inverted_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.invert_network(_day_pairs(spark, d), ["px"], "i", "j", "y", "coh"), 5)


@query()
def linked_phases(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.link_phases(_day_pairs(spark, d), ["px"], "i", "j", "phase", "coh"), 4)


@query()
def smoothed_series(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.ou_smooth(_day_pairs(spark, d), ["px"], "i", "j", "y", "sd", 25.0, 2.0, 2 * math.pi), 5)


@query()
def gp_predictions(spark: SparkSession, d: str) -> DataFrame:
    s = scenes(spark, d).where("vv_db_3x3 IS NOT NULL").select(F.concat_ws("|", *SERIES).alias("px"), F.concat_ws("|", "track", "date").alias("id"), F.unix_date("date").alias("t"), F.col("vv_db_3x3").alias("v"))
    once = s.withColumn("n", F.row_number().over(Window.partitionBy("px", "t").orderBy("id"))).where("n = 1")
    return rounded(kernels.gp_leave_one_out(once, ["px"], "id", "t", "v", 20.0, 0.1), 5)
