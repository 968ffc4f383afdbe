"""Queries of joins by range and containment, shifts, homogeneous neighbours and nulls by resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quagmark.operators import hydro, kernels, pairs, resample, spatial, stats, temporal
from quagmark.plans.book import query, rounded
from quagmark.plans.grids import _GRID, grid
from quagmark.plans.numbers import _MONTHLY, monthly
from quagmark.plans.series import _SCENES, SERIES, scenes
from quagmark.sources.tables import table


def shipments(spark: SparkSession, d: str) -> DataFrame:
    """Line items as pairs of days, shipped and received."""
    day = lambda c: F.unix_date(F.to_date(c))
    return table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_discount", day("l_shipdate").alias("t1"), day("l_shipdate").alias("t0"), (day("l_shipdate") + F.col("l_linenumber") * 3).alias("t2"))


_SHIPMENTS = "WITH s AS (SELECT l_suppkey, l_returnflag, l_discount, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS t1, CAST(l_shipdate AS DATE) - DATE '1970-01-01' + l_linenumber * 3 AS t2 FROM lineitem)"


@query(f"""{_SHIPMENTS}, m AS (SELECT a.l_suppkey AS k, a.t1 AS a1, a.t2 AS a2, b.t1 AS b1, b.t2 AS b2 FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND abs(b.t1 - a.t1 - 2) <= 3 AND abs(b.t2 - a.t2 - 2) <= 3),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, a1, a2 ORDER BY b1, b2) = 1) SELECT k AS l_suppkey, CAST(a1 AS INTEGER) AS a_t1, CAST(a2 AS INTEGER) AS a_t2, CAST(b1 AS INTEGER) AS b_t1, CAST(b2 AS INTEGER) AS b_t2 FROM o QUALIFY row_number() OVER (PARTITION BY k, b1, b2 ORDER BY a1, a2) = 1""")
def matched_ends(spark: SparkSession, d: str) -> DataFrame:
    s = shipments(spark, d)
    out = pairs.both_ends(s.where("l_returnflag = 'A'"), s.where("l_returnflag = 'R'"), ["l_suppkey"], "t1", "t2", 2.0, 3.0)
    return out.select("l_suppkey", *(F.col(c).cast("int").alias(c) for c in ("a_t1", "a_t2", "b_t1", "b_t2")))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, l_shipdate::DATE - DATE '1970-01-01' AS t0, l_shipdate::DATE - DATE '1970-01-01' + l_linenumber AS t1, l_shipdate::DATE - DATE '1970-01-01' + l_linenumber * 3 AS t2 FROM lineitem),
m AS (SELECT a.l_suppkey AS k, a.t0 AS a0, a.t1 AS a1, a.t2 AS a2, b.t0 AS b0, b.t1 AS b1, b.t2 AS b2 FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'N' AND b.l_returnflag = 'R' AND abs(b.t0 - a.t0 + 2) <= 3 AND abs(b.t1 - a.t1 + 2) <= 3 AND abs(b.t2 - a.t2 + 2) <= 3),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, a0 ORDER BY b0, b1, b2, a0, a1, a2) = 1), z AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY k, b0 ORDER BY a0, a1, a2, b0, b1, b2) = 1)
SELECT k AS l_suppkey, CAST(a0 AS INTEGER) AS a_t0, CAST(a1 AS INTEGER) AS a_t1, CAST(a2 AS INTEGER) AS a_t2, CAST(b0 AS INTEGER) AS b_t0, CAST(b1 AS INTEGER) AS b_t1, CAST(b2 AS INTEGER) AS b_t2 FROM z""")
def matched_triples(spark: SparkSession, d: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate"))
    s = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", day.alias("t0"), (day + F.col("l_linenumber")).alias("t1"), (day + F.col("l_linenumber") * 3).alias("t2"))
    out = pairs.all_dates(s.where("l_returnflag = 'N'"), s.where("l_returnflag = 'R'"), ["l_suppkey"], ["t0", "t1", "t2"], -2.0, 3.0, 1)
    return out.select("l_suppkey", *(F.col(f"{x}_t{n}").cast("int").alias(f"{x}_t{n}") for x in "ab" for n in range(3)))


@query(f"""{_SHIPMENTS}, e AS (SELECT l_suppkey, t1 AS t FROM s UNION SELECT l_suppkey, t2 FROM s), g AS (SELECT l_suppkey, t, lead(t) OVER (PARTITION BY l_suppkey ORDER BY t) AS n FROM e)
SELECT l_suppkey, CAST(t AS INTEGER) AS t1, CAST(n AS INTEGER) AS t2, EXISTS (SELECT 1 FROM s WHERE s.l_suppkey = g.l_suppkey AND s.t1 <= g.t AND s.t2 >= g.n AND l_discount >= 0.08) AS bridged FROM g WHERE n IS NOT NULL""")
def bridged_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.bridged_gaps(shipments(spark, d), ["l_suppkey"], "t1", "t2", F.col("l_discount") >= 0.08)
    return out.select("l_suppkey", F.col("t1").cast("int").alias("t1"), F.col("t2").cast("int").alias("t2"), "bridged")


@query(f"""{_SHIPMENTS} SELECT l_suppkey, count(*) AS n, CAST(sum(t2 - t1) AS BIGINT) AS days FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.l_suppkey = s.l_suppkey AND x.l_returnflag = 'R' AND x.t1 > s.t1 AND x.t1 < s.t2) GROUP BY 1""")
def undisturbed_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = shipments(spark, d)
    out = pairs.none_between(s.select("l_suppkey", "t1", "t2"), s.where("l_returnflag = 'R'").select("l_suppkey", "t0"), ["l_suppkey"], "t1", "t2", "t0")
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("t2") - F.col("t1")).cast("long").alias("days"))


@query("""WITH q AS (SELECT plot_acq_id, station, plot, time_utc FROM plots_acq WHERE time_utc IS NOT NULL), h AS (SELECT station, plot, time_utc AS t, max(laser_surface_cm) AS v FROM site_hourly WHERE laser_ok AND NOT isnan(laser_surface_cm) GROUP BY ALL),
j AS (SELECT plot_acq_id, v, date_diff('microsecond', time_utc, t) / 3.6e9 AS lag_h FROM q JOIN h ON q.station = h.station AND q.plot = h.plot AND abs(date_diff('microsecond', time_utc, t)) <= 259200000000 QUALIFY row_number() OVER (PARTITION BY plot_acq_id ORDER BY abs(date_diff('microsecond', time_utc, t)), t) = 1)
SELECT plot_acq_id, round(v, 6) AS laser_surface_cm, round(lag_h, 6) AS lag_h FROM q LEFT JOIN j USING (plot_acq_id)""")
def nearest_valid_scene(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "plots_acq").where("time_utc IS NOT NULL").select("plot_acq_id", *SERIES, "time_utc")
    h = table(spark, d, "site_hourly").groupBy(*SERIES, "time_utc", F.col("laser_ok").cast("double").alias("valid")).agg(F.max("laser_surface_cm").alias("laser_surface_cm"))
    return rounded(temporal.nearest_valid(q, h, SERIES, "time_utc", "laser_surface_cm", "valid", 3 * 86_400).select("plot_acq_id", "laser_surface_cm", "lag_h"))


@query(f"""{_SCENES}, p AS (SELECT station, plot, track, date AS t1, lead(date) OVER (PARTITION BY station, plot, track ORDER BY date) AS t2 FROM a QUALIFY t2 IS NOT NULL), h AS (SELECT station, plot, time_utc AS t, max(air_c) + 40 AS pwv FROM site_hourly WHERE NOT isnan(air_c) GROUP BY ALL),
n1 AS (SELECT p.*, pwv AS a, row_number() OVER (PARTITION BY p.station, p.plot, track, t1 ORDER BY abs(date_diff('second', t1 + INTERVAL 16 HOURS, t)), t) AS k FROM p JOIN h ON p.station = h.station AND p.plot = h.plot AND abs(date_diff('second', t1 + INTERVAL 16 HOURS, t)) <= 43200 QUALIFY k = 1),
n2 AS (SELECT p.*, pwv AS b, row_number() OVER (PARTITION BY p.station, p.plot, track, t1 ORDER BY abs(date_diff('second', t2 + INTERVAL 16 HOURS, t)), t) AS k FROM p JOIN h ON p.station = h.station AND p.plot = h.plot AND abs(date_diff('second', t2 + INTERVAL 16 HOURS, t)) <= 43200 QUALIFY k = 1)
SELECT p.station, p.plot, p.track, p.t1, p.t2, round(6.2 * (b - a), 4) AS delay_mm FROM p LEFT JOIN n1 USING (station, plot, track, t1) LEFT JOIN n2 USING (station, plot, track, t1)""")
def wet_delays(spark: SparkSession, d: str) -> DataFrame:
    a = scenes(spark, d)
    p = a.withColumn("t2", F.lead("date").over(_by_track())).where("t2 IS NOT NULL").select(*SERIES, "track", F.col("date").alias("t1"), "t2")
    water = table(spark, d, "site_hourly").where("air_c IS NOT NULL").groupBy(*SERIES, "time_utc").agg((F.max("air_c") + 40).alias("pwv"))
    return rounded(hydro.pair_wet_delays(p, water, SERIES, "t1", "t2", "time_utc", "pwv", 16), 4)


_AT = "CASE WHEN f.t = b.t THEN b.v WHEN f.t IS NOT NULL AND b.t IS NOT NULL THEN b.v + date_diff('microsecond', b.t, {q}) / date_diff('microsecond', b.t, f.t)::DOUBLE * (f.v - b.v) END"


@query(f"""WITH h AS (SELECT station, plot, time_utc AS t, max(air_c) AS v FROM site_hourly WHERE NOT isnan(air_c) GROUP BY ALL), q AS (SELECT plot_acq_id, station, plot, time_utc AS t FROM plots_acq WHERE time_utc IS NOT NULL),
x AS (SELECT plot_acq_id, station, plot, t, 0 AS back FROM q UNION ALL SELECT plot_acq_id, station, plot, t - INTERVAL 72 HOURS, 72 FROM q),
y AS (SELECT x.plot_acq_id, back, {_AT.format(q='x.t')} AS v FROM x ASOF LEFT JOIN h b ON x.station = b.station AND x.plot = b.plot AND x.t >= b.t ASOF LEFT JOIN h f ON x.station = f.station AND x.plot = f.plot AND x.t <= f.t)
SELECT plot_acq_id, round(any_value(v) FILTER (back = 0), 5) AS air_at, round(any_value(v) FILTER (back = 0) - any_value(v) FILTER (back = 72), 5) AS air_d72h FROM y GROUP BY 1""")
def antecedent_changes(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "site_hourly").where("air_c IS NOT NULL").groupBy(*SERIES, "time_utc").agg(F.max("air_c").alias("air_c"))
    q = table(spark, d, "plots_acq").where("time_utc IS NOT NULL").select("plot_acq_id", *SERIES, "time_utc")
    return rounded(temporal.changes(q, h, SERIES, "time_utc", "air_c", [72], "air").select("plot_acq_id", "air_at", "air_d72h"), 5)


def _by_track():
    from pyspark.sql import Window

    return Window.partitionBy(*SERIES, "track").orderBy("date")


@query(f"""{_GRID}, s AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc)) SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, round(corr(x.v, y.v + 20 * y.size), 5) AS score, count(x.v) FILTER (y.v IS NOT NULL) AS n FROM s CROSS JOIN g x JOIN g y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY ALL""")
def shift_scores(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    other = g.select("row", "col", (F.col("v") + 20 * F.col("size")).alias("w"))
    score = lambda a, b: stats.corr(a, b)
    return rounded(spatial.shift_scores(g.select("row", "col", "v"), other, "row", "col", "v", "w", 2, score), 5)


@query(f"""{_GRID}, s AS (SELECT dr, dc FROM range(-2, 3) a(dr), range(-2, 3) b(dc)), k AS (SELECT dr, dc, corr(x.v, y.v + 20 * y.size) AS score FROM s CROSS JOIN g x JOIN g y ON y.r = x.r + dr AND y.c = x.c + dc GROUP BY ALL)
SELECT CAST(dr AS INTEGER) AS dr, CAST(dc AS INTEGER) AS dc, round(score, 5) AS score FROM k ORDER BY score DESC, dr, dc LIMIT 1""")
def best_shift(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    other = g.select("row", "col", (F.col("v") + 20 * F.col("size")).alias("w"))
    return rounded(spatial.best_shift(spatial.shift_scores(g.select("row", "col", "v"), other, "row", "col", "v", "w", 2, stats.corr)), 5)


_STACK = """WITH a AS (SELECT CAST(l_partkey // 50 AS INTEGER) AS row, CAST(l_partkey % 50 AS INTEGER) AS col, l_quantity AS x, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS t FROM lineitem QUALIFY t <= 8),
p AS (SELECT row, col, list(x ORDER BY t) AS amp FROM a GROUP BY ALL HAVING count(*) = 8)"""


def stack(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with their amplitudes on eight dates."""
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").withColumn("t", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))).where("t <= 8")
    p = li.groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("t", F.col("l_quantity").cast("double").alias("x")))).alias("s")).where(F.size("s") == 8)
    k = F.col("l_partkey")
    return p.select(F.floor(k / 50).cast("int").alias("row"), (k % 50).cast("int").alias("col"), F.transform("s", lambda e: e["x"]).alias("amp"))


@query(f"""{_STACK}, n AS (SELECT a.row, a.col, list_max(list_transform(list_concat(a.amp, b.amp), lambda v: abs(len(list_filter(a.amp, lambda x: x <= v)) - len(list_filter(b.amp, lambda x: x <= v))))) / 8.0 AS ks FROM p a JOIN p b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND NOT (a.row = b.row AND a.col = b.col))
SELECT row, col, count(*) AS neighbours, count(*) FILTER (ks < 1.358 * sqrt(2.0 / 8)) AS alike FROM n GROUP BY ALL""")
def homogeneous_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = kernels.homogeneous(stack(spark, d), [], "row", "col", "amp", 1, 2)
    return n.groupBy("row", "col").agg(F.count("*").alias("neighbours"), F.count_if("alike").alias("alike"))


_PERMUTED = f"""{_MONTHLY}, i AS (SELECT month(m) AS g, CAST(m AS VARCHAR) AS id, q, x FROM mo), dr AS (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS draw), o AS (SELECT draw, i.*, row_number() OVER (PARTITION BY draw, g ORDER BY id) AS i, row_number() OVER (PARTITION BY draw, g ORDER BY md5('3-' || draw || '-' || id), id) AS j FROM dr CROSS JOIN i),
r AS (SELECT a.draw, corr(b.q, a.x) AS r FROM o a JOIN o b ON a.draw = b.draw AND a.g = b.g AND a.i = b.j GROUP BY 1)"""


@query(f"{_PERMUTED} SELECT draw, round(r, 6) AS r FROM r")
def permuted_months(spark: SparkSession, d: str) -> DataFrame:
    """r of two monthly series with one of them permuted within the month of the year."""
    m = monthly(spark, d).select(F.month("m").alias("g"), F.col("m").cast("string").alias("id"), "q", "x")
    return rounded(resample.permuted_within(m, ["g"], "id", "q", 100, 3).groupBy("draw").agg(stats.corr("q_permuted", "x").alias("r")))


_NULL_ZONES = f"""{_GRID}, c AS (SELECT r, c, v FROM g WHERE size > 10), t AS (SELECT CAST(unnest(range(0, 20)) AS INTEGER) AS trial), s AS (SELECT trial, r AS sr, c AS sc, CAST('0x' || substr(md5('5-' || trial), 1, 8) AS BIGINT) / 4294967296.0 * pi() AS angle FROM t CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY trial ORDER BY md5('5-' || trial || '-' || r || '-' || c), r, c) = 1),
p AS (SELECT trial, r, c, v, angle FROM s CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY trial ORDER BY (r - sr) * (r - sr) + (c - sc) * (c - sc), r, c) <= 60),
z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY trial ORDER BY round(r * cos(angle) + c * sin(angle), 6), r, c) <= 20 THEN 'target' ELSE 'reference' END AS zone FROM p)"""


@query(f"{_NULL_ZONES} SELECT trial, round(avg(v) FILTER (zone = 'target') - avg(v) FILTER (zone = 'reference'), 5) AS difference, count(*) FILTER (zone = 'target') AS n_target, count(*) FILTER (zone = 'reference') AS n_reference FROM z GROUP BY 1")
def null_zones(spark: SparkSession, d: str) -> DataFrame:
    """The null distribution of a difference of zone means, from patches of the real zones' sizes."""
    g = grid(spark, d)
    # 60 cells a trial at most: these are broadcast, not the grid
    z = F.broadcast(resample.matched_zones(g.where("size > 10"), "row", "col", 20, 40, 20, 5)).join(g, ["row", "col"])
    mean = lambda k: F.avg(F.when(F.col("zone") == k, F.col("v")))
    return rounded(z.groupBy("trial").agg((mean("target") - mean("reference")).alias("difference"), F.count_if(F.col("zone") == "target").alias("n_target"), F.count_if(F.col("zone") == "reference").alias("n_reference")), 5)


_U = "CAST('0x' || substr(md5('11-' || n || '-{k}'), 1, 8) AS BIGINT)"


def _pair_sql(k: str) -> str:
    r, v = f"sqrt(-2 * ln(({_U.format(k=k + 'a')} + 0.5) / 4294967296.0))", f"({_U.format(k=k + 'b')} / 4294967296.0 * 2 * pi())"
    return f"{r} * cos({v}) AS {k}_x, {r} * sin({v}) AS {k}_y"


@query(f"""WITH m AS (SELECT l_returnflag, avg(l_quantity) AS ac, avg(l_discount) * 100 AS an, avg(l_tax) * 100 AS bc, avg(l_linenumber) AS bn, var_samp(l_discount) * 100 AS vc, var_samp(l_tax) * 400 AS vn FROM lineitem GROUP BY 1), n AS (SELECT unnest(range(0, 500)) AS n), d AS (SELECT n, {_pair_sql('a')}, {_pair_sql('b')} FROM n),
x AS (SELECT l_returnflag, ac + sqrt(vc) * a_x AS acos, an + 0.5 * sqrt(vn) * a_x + sqrt(0.75 * vn) * a_y AS asin, bc + sqrt(vc) * b_x AS bcos, bn + 0.5 * sqrt(vn) * b_x + sqrt(0.75 * vn) * b_y AS bsin FROM m CROSS JOIN d),
e AS (SELECT l_returnflag, sqrt(((0.78 * acos - 0.77 * bcos) / (-0.62 * 0.78 - 0.63 * 0.77)) ** 2 + ((0.78 * asin - 0.77 * bsin) / (-0.62 * 0.78 - 0.63 * 0.77)) ** 2) AS east, sqrt(((-0.62 * bcos - 0.63 * acos) / (-0.62 * 0.78 - 0.63 * 0.77)) ** 2 + ((-0.62 * bsin - 0.63 * asin) / (-0.62 * 0.78 - 0.63 * 0.77)) ** 2) AS up FROM x),
u AS (SELECT l_returnflag, 'east' AS direction, east AS v FROM e UNION ALL SELECT l_returnflag, 'up', up FROM e)
SELECT l_returnflag, direction, round(median(v), 5) AS median, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd, round(quantile_cont(v, 0.025), 5) AS low, round(quantile_cont(v, 0.975), 5) AS high FROM u GROUP BY ALL""")
def sight_amplitudes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_quantity").alias("a_cos"), (F.avg("l_discount") * 100).alias("a_sin"), (F.avg("l_tax") * 100).alias("b_cos"), F.avg("l_linenumber").alias("b_sin"),
        (F.var_samp("l_discount") * 100).alias("vc"), (F.var_samp("l_tax") * 400).alias("vn"),
    )
    cov = 0.5 * F.sqrt(F.col("vc") * F.col("vn"))
    m = m.select("l_returnflag", "a_cos", "a_sin", "b_cos", "b_sin", *(c.alias(f"{k}_{n}") for k in "ab" for n, c in (("cc", F.col("vc")), ("ss", F.col("vn")), ("cs", cov))))
    return rounded(resample.two_sight_amplitudes(m, ["l_returnflag"], ((-0.62, 0.77), (0.63, 0.78)), 500, 11), 5)
