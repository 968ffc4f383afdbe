"""Queries of field masks, zones and small models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quagmark.operators import field, models, stats, zones
from quagmark.plans.book import query, r6, rounded
from quagmark.plans.grids import _GRID, grid
from quagmark.plans.series import _RAIN, SERIES, rain_days
from quagmark.sources.tables import table

_AIR = "WITH s AS (SELECT station, plot, time_utc, arg_max(CASE WHEN isnan(air_c) THEN NULL ELSE air_c END, ingested_at) AS air, bool_or(snow_evidence) AS ev, max(CASE WHEN isnan(rain_mm) THEN NULL ELSE rain_mm END) AS rain FROM site_hourly GROUP BY ALL)"
_W72 = "(PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 259199999999 MICROSECONDS PRECEDING AND CURRENT ROW)"


def air_hours(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_hourly").groupBy(*SERIES, "time_utc")
    return s.agg(F.max_by("air_c", F.when(F.col("air_c").isNotNull(), F.col("ingested_at"))).alias("air"), F.bool_or("snow_evidence").alias("ev"), F.max("rain_mm").alias("rain"))


@query(f"{_AIR} SELECT station, plot, time_utc, max(CASE WHEN coalesce(air < 0, true) THEN 1 ELSE 0 END) OVER {_W72} = 1 AS snow FROM s")
def frost_mask(spark: SparkSession, d: str) -> DataFrame:
    return field.frost_mask(air_hours(spark, d), SERIES, "time_utc", "air").select(*SERIES, "time_utc", "snow")


@query(f"{_AIR} SELECT station, plot, time_utc, max(CASE WHEN coalesce(rain > 2, false) OR coalesce(CAST(ev AS INTEGER) > 0, false) THEN 1 ELSE 0 END) OVER {_W72} = 1 AS snow FROM s")
def evidence_mask(spark: SparkSession, d: str) -> DataFrame:
    s = air_hours(spark, d).withColumn("ev", F.col("ev").cast("int"))
    return field.evidence_mask(s, SERIES, "time_utc", {"rain": 2, "ev": 0}).select(*SERIES, "time_utc", "snow")


@query(f"{_AIR} SELECT station, plot, time_utc, (air * 10 >= 95) OR (sum(rain) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 10799999999 MICROSECONDS PRECEDING AND CURRENT ROW) > 0) AS wet, air < 0 AS frozen FROM s")
def wetness(spark: SparkSession, d: str) -> DataFrame:
    s = air_hours(spark, d).withColumn("rh", F.col("air") * 10)
    return field.wetness(s, SERIES, "time_utc", "rh", "rain", "air").select(*SERIES, "time_utc", "wet", "frozen")


_LEVELS = "h AS (SELECT station, plot, time_utc AS t, arg_min(surface_cm, reading_id) AS v FROM laser_hourly WHERE surface_cm IS NOT NULL AND NOT isnan(surface_cm) GROUP BY ALL)"


def level_hours(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "laser_hourly").where("surface_cm IS NOT NULL")
    return h.groupBy(*SERIES, F.col("time_utc").alias("t")).agg(F.min_by("surface_cm", "reading_id").alias("v"))


@query(f"""WITH {_LEVELS}, f AS (SELECT station, plot, quantile_cont(v, 0.02) AS f FROM h GROUP BY ALL), l AS (SELECT h.*, v <= f + 1.5 AS low FROM h JOIN f USING (station, plot)),
r AS (SELECT *, sum(CASE WHEN p = low THEN 0 ELSE 1 END) OVER (PARTITION BY station, plot ORDER BY t) AS run FROM (SELECT *, lag(low) OVER (PARTITION BY station, plot ORDER BY t) AS p FROM l))
SELECT station, plot, t, low AND date_diff('microsecond', min(t) OVER (PARTITION BY station, plot, run), max(t) OVER (PARTITION BY station, plot, run)) >= 432000000000 AS censored FROM r""")
def floor_plateaus(spark: SparkSession, d: str) -> DataFrame:
    return field.floor_plateaus(level_hours(spark, d), SERIES, "t", "v").select(*SERIES, "t", "censored")


@query(f"""WITH {_LEVELS}, x AS (SELECT *, lag(v) OVER w AS v0, lead(v) OVER w AS v1, date_diff('microsecond', lag(t) OVER w, t) AS d0, date_diff('microsecond', lag(t) OVER w, lead(t) OVER w) AS d1 FROM h WINDOW w AS (PARTITION BY station, plot ORDER BY t)),
o AS (SELECT *, coalesce(abs(v - v0 - d0 / d1 * (v1 - v0)) <= 0.001 AND abs(v1 - v0) > 0.001, false) AS line FROM x),
r AS (SELECT *, sum(CASE WHEN p = line THEN 0 ELSE 1 END) OVER (PARTITION BY station, plot ORDER BY t) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY station, plot ORDER BY t) AS p FROM o))
SELECT station, plot, min(t) AS first, max(t) AS last, count(*) AS n FROM r WHERE line GROUP BY station, plot, run HAVING count(*) >= 6""")
def filled_stretches(spark: SparkSession, d: str) -> DataFrame:
    return field.filled_stretches(level_hours(spark, d), SERIES, "t", "v")


@query()
def grid_offsets(spark: SparkSession, d: str) -> DataFrame:
    return field.grid_offsets(level_hours(spark, d), SERIES, "t", "v", 0.1, 3)


@query(f"""WITH {_LEVELS}, f AS (SELECT station, plot, min(t) + INTERVAL 2 DAY AS a, min(t) + INTERVAL 5 DAY AS b FROM h GROUP BY ALL) SELECT h.station, h.plot, h.t, h.t >= a AND h.t <= b AS inside FROM h JOIN f USING (station, plot)""")
def in_runs(spark: SparkSession, d: str) -> DataFrame:
    h = level_hours(spark, d)
    runs = h.groupBy(*SERIES).agg(F.min("t").alias("m")).select(*SERIES, (F.col("m") + F.expr("INTERVAL 2 DAYS")).alias("a"), (F.col("m") + F.expr("INTERVAL 5 DAYS")).alias("b"))
    return field.in_runs(h, runs, SERIES, "t", "a", "b").select(*SERIES, "t", "inside")


@query(f"""WITH {_LEVELS}, s AS (SELECT station, plot, v - lag(v) OVER w AS dv, date_diff('microsecond', lag(t) OVER w, t) AS g FROM h WINDOW w AS (PARTITION BY station, plot ORDER BY t)) SELECT station, plot, round(stddev_samp(dv), 5) AS noise, count(*) AS n FROM s WHERE abs(dv) < 5 AND g <= 7200000000 GROUP BY ALL""")
def difference_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(field.difference_noise(level_hours(spark, d), SERIES, "t", "v", 5.0, 7200), 5)


@query("""SELECT l_linenumber AS pair, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount * 10 END), 6) AS mean, round(median(CASE WHEN l_returnflag = 'A' THEN l_discount * 10 END), 6) AS median, round(count(*) FILTER (l_returnflag = 'A' AND l_discount * 10 > 0.3) / count(*) FILTER (l_returnflag = 'A'), 6) AS share_above FROM lineitem GROUP BY 1""")
def pair_coherence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumns({"c": F.col("l_discount") * 10, "pair": F.col("l_linenumber")})
    return rounded(zones.pair_stats(li, ["pair"], "c", F.col("l_returnflag") == "A"))


@query("SELECT l_suppkey, round(stddev_pop(l_tax) / avg(l_tax), 6) AS dispersion, count(*) AS n FROM lineitem WHERE l_tax > 0 GROUP BY 1 HAVING count(*) >= 2")
def amplitude_dispersion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.dispersion(table(spark, d, "lineitem"), ["l_suppkey"], "l_tax").where("dispersion IS NOT NULL"))


@query("SELECT l_suppkey, round(avg(l_tax), 6) AS green, round(quantile_cont(l_tax, 0.9) - quantile_cont(l_tax, 0.1), 6) AS amplitude, round(avg(l_discount), 6) AS wet FROM lineitem GROUP BY 1")
def landcover_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.landcover_features(table(spark, d, "lineitem"), ["l_suppkey"], "l_tax", "l_discount"))


@query("SELECT l_partkey, round(avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0 END), 6) AS share FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0 END) > 0.6")
def persistent_water(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.persistent(table(spark, d, "lineitem"), ["l_partkey"], "l_discount", 0.04, 0.6))


@query("WITH p AS (SELECT l_returnflag, l_partkey, avg(CASE WHEN l_tax > 0.01 THEN CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0 END END) AS s FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(CAST(count(*) FILTER (s >= 0.5) * 0.04 AS DOUBLE), 6) AS ha FROM p GROUP BY 1")
def water_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.water_area(table(spark, d, "lineitem"), ["l_partkey"], ["l_returnflag"], F.col("l_discount") > 0.04, F.col("l_tax") > 0.01))


@query("WITH s AS (SELECT l_returnflag, l_shipdate, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER) AS month, round(avg(m), 6) AS mean, count(m) AS n FROM s GROUP BY 1, 2")
def phenology(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.phenology(table(spark, d, "lineitem"), "l_returnflag", "l_shipdate", "l_discount"))


@query("SELECT unit, date, round(CASE WHEN count(CASE WHEN NOT isnan(vv_db_3x3) THEN 1 END) >= 0.5 * count(*) THEN median(CASE WHEN NOT isnan(vv_db_3x3) THEN vv_db_3x3 END) END, 6) AS median, count(CASE WHEN NOT isnan(vv_db_3x3) THEN 1 END) AS n FROM plots_acq GROUP BY ALL")
def zone_backscatter(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.zone_series(table(spark, d, "plots_acq"), "unit", "date", "vv_db_3x3"))


@query("WITH g AS (SELECT l_orderkey, avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag = 'R') AS delta FROM lineitem GROUP BY 1) SELECT l_orderkey, round(delta, 6) AS delta FROM g WHERE delta IS NOT NULL")
def zone_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.zone_deltas(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", "A", "R"))


@query("SELECT track, round(avg(v) FILTER (f) - avg(v) FILTER (NOT f), 6) AS gain, count(v) FILTER (f) AS n_true, count(v) FILTER (NOT f) AS n_false FROM (SELECT track, CASE WHEN isnan(vv_db_3x3) THEN NULL ELSE vv_db_3x3 END AS v, flag_frozen_air AS f FROM plots_acq) GROUP BY 1 HAVING count(v) FILTER (f) >= 3 AND count(v) FILTER (NOT f) >= 3")
def freeze_gain(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.gain(table(spark, d, "plots_acq"), ["track"], "vv_db_3x3", F.col("flag_frozen_air")).where("gain IS NOT NULL"))


@query()
def coherence_decay(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumns({"days": (F.col("l_linenumber") * 12).cast("double"), "coh": 0.3 + 0.5 * F.exp(-F.col("l_linenumber") * 12 / 30.0) + F.col("l_discount")})
    return rounded(zones.decay(li, ["l_returnflag"], "days", "coh", [5, 10, 20, 30, 45, 60, 90]), 3)


@query("WITH c AS (SELECT l_partkey, count(*) AS n, corr(l_quantity, l_extendedprice) AS r, sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 5) SELECT l_partkey, n, round(r, 5) AS r, round(s, 4) AS slope FROM c WHERE n >= 5")
def column_links(spark: SparkSession, d: str) -> DataFrame:
    c = zones.column_links(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")
    return c.select("l_partkey", "n", F.round("r", 5).alias("r"), F.round("slope", 4).alias("slope"))


@query(f"""{_GRID}, m AS (SELECT r, c, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM g WHERE v IS NOT NULL), k AS (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS lag), p AS (SELECT lag, a.z AS x, b.z AS y FROM k CROSS JOIN m a JOIN m b ON (b.r = a.r + lag AND b.c = a.c) OR (b.r = a.r AND b.c = a.c + lag)),
q AS (SELECT lag, avg(x * y) AS rho, count(*) AS n FROM p GROUP BY 1) SELECT lag, round(rho, 6) AS rho, n, min(CASE WHEN rho < exp(-1) THEN lag END) OVER () AS length FROM q""")
def correlation_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(zones.correlation_length(grid(spark, d), "row", "col", "v", 6))


@query("""WITH t AS (SELECT l_returnflag, unnest([1.0, 2.0, 3.0]) AS k, l_quantity, l_tax, l_extendedprice FROM lineitem), s AS (SELECT l_returnflag, k, sum(l_quantity * l_quantity) AS a, sum(l_quantity * pow(l_tax * 100, k)) AS b, sum(pow(l_tax * 100, 2 * k)) AS c, sum(l_quantity * l_extendedprice) AS p, sum(pow(l_tax * 100, k) * l_extendedprice) AS q, sum(l_extendedprice * l_extendedprice) AS yy, count(*) AS n FROM t GROUP BY ALL),
f AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS k1, (a * q - b * p) / (a * c - b * b) AS k2 FROM s) SELECT l_returnflag, CAST(k AS DOUBLE) AS power, round(k1, 3) AS k1, round(k2, 3) AS k2, n FROM f QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY yy - k1 * p - k2 * q) = 1""")
def grid_fit(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").withColumn("power", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    g = models.grid_fit(li, ["l_returnflag"], "power", F.col("l_quantity"), F.pow(F.round(F.col("l_tax") * 100, 6), "power"), F.col("l_extendedprice"))
    return g.select("l_returnflag", "power", F.round("k1", 3).alias("k1"), F.round("k2", 3).alias("k2"), "n")


@query("""WITH e AS (SELECT user_id, event_id, value - 50 AS u, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - 50 AS z FROM events), f AS (SELECT user_id, event_id, CASE WHEN z IS NOT NULL AND abs(z - u) <= 3 * sqrt(4 + 9) THEN u + 4 / 13.0 * (z - u) ELSE u END AS fused FROM e)
SELECT event_id, round(fused, 6) AS fused, round(sum(fused) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS level FROM f""")
def fused_increments(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") - 50).alias("u"), (F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")) - 50).alias("z"), F.lit(4.0).alias("q"), F.lit(9.0).alias("r"))
    f = models.fuse(e, ["user_id"], "event_id", "u", "q", "z", "r")
    return f.select("event_id", r6(F.col("fused")).alias("fused"), F.round("level", 4).alias("level"))


@query(f"""{_RAIN} SELECT station, plot, day, round(atan2(sin(rain + lead(rain) OVER w - air), cos(rain + lead(rain) OVER w - air)), 5) AS c2, round(atan2(sin(rain + lead(rain) OVER w + lead(rain, 2) OVER w - tmax), cos(rain + lead(rain) OVER w + lead(rain, 2) OVER w - tmax)), 5) AS c3 FROM f WINDOW w AS (PARTITION BY station, plot ORDER BY day)""")
def phase_biases(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.phase_biases(rain_days(spark, d), SERIES, "day", "rain", "air", "tmax").select(*SERIES, "day", "c2", "c3"), 5)


@query("""WITH e AS (SELECT event_id, event_type, user_id % 10 AS seg, value, CASE WHEN user_id % 3 = 0 THEN 50.0 END AS prior FROM events) SELECT event_id, round(value + coalesce(avg(prior - value) OVER (PARTITION BY event_type, seg), 0), 9) AS level FROM e""")
def tied_segments(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("seg"), F.col("value").alias("level"), F.when(F.col("user_id") % 3 == 0, 50.0).alias("prior"))
    return rounded(models.tie_segments(e, ["event_type"], "seg", "level", "prior").select("event_id", "level"), 9)


@query()
def ou_parameters(spark: SparkSession, d: str) -> DataFrame:
    days = rain_days(spark, d).where("air IS NOT NULL").withColumn("t", F.unix_date("day"))
    return rounded(models.ou_parameters(days, SERIES, "t", "air", 10), 4)


@query()
def bucket_fit(spark: SparkSession, d: str) -> DataFrame:
    days = rain_days(spark, d).withColumn("level", F.col("tmax"))
    f = models.bucket_fit(days, SERIES, "day", "level", "rain", "air")
    return f.select(*SERIES, "n", F.transform("b", lambda x: F.round(x, 4)).alias("b"), r6(F.col("r2")).alias("r2"))


@query()
def nested_selection(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("yr")).agg(F.avg("o_totalprice").alias("v"), F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("m"))
    return rounded(models.nested_selection(y, ["o_orderpriority"], ["n", "m"], "v"), 2)


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus)) / stddev_pop(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS z FROM orders")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return rounded(stats.standardized(o, ["o_orderstatus"], "o_totalprice", "z").select("o_orderkey", "z"))
