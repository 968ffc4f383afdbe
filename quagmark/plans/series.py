"""Queries over time series: as-of joins, windows, runs, chains, scoring, gold tables, water."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quagmark.functions import scalar
from quagmark.operators import gold, hydro, islands, scoring, temporal
from quagmark.plans.book import query, r6, rounded
from quagmark.sources.tables import table

SERIES = ["station", "plot"]
USER = ["user_id"]


def events(spark: SparkSession, d: str, *types: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.col("event_type").isin(*types)) if types else e


_NEAREST = """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS c_id, user_id, ts AS cts, value AS c_value FROM events WHERE event_type = 'click'),
j AS (SELECT p.event_id, c_id, c_value, date_diff('microsecond', ts, cts) AS dus, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(date_diff('microsecond', ts, cts)), cts, c_id DESC) AS n FROM p JOIN c ON p.user_id = c.user_id AND {cond})
SELECT p.event_id, j.c_id, round(j.dus / 3.6e9, 6) AS lag_h FROM p LEFT JOIN j ON p.event_id = j.event_id AND n = 1"""


def _asof(spark, d, tolerance, direction):
    p = events(spark, d, "purchase").select("event_id", "user_id", "ts")
    c = events(spark, d, "click").select("user_id", "ts", F.col("event_id").alias("c_id"))
    return temporal.asof(p, c, USER, "ts", ["c_id"], tolerance, direction, "c_id").select("event_id", "c_id", r6(F.col("lag_h")).alias("lag_h"))


@query(_NEAREST.format(cond="abs(date_diff('microsecond', ts, cts)) <= 7200000000"))
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, 7200, "nearest")


@query(_NEAREST.format(cond="cts <= ts"))
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, None, "backward")


@query(_NEAREST.format(cond="cts >= ts AND date_diff('microsecond', ts, cts) <= 21600000000"))
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, 21600, "forward")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
b AS (SELECT p.event_id, p.ts, v.ts AS bt, v.value AS bv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts),
f AS (SELECT p.event_id, v.ts AS ft, v.value AS fv FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.ts)
SELECT b.event_id, round(CASE WHEN bt = b.ts THEN bv WHEN date_diff('microsecond', bt, ft) <= 1728000000000 THEN bv + (fv - bv) * date_diff('microsecond', bt, b.ts) / date_diff('microsecond', bt, ft) END, 6) AS view_value
FROM b JOIN f USING (event_id)""")
def value_at(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d, "purchase").select("event_id", "user_id", "ts")
    return temporal.value_at(p, events(spark, d, "view"), USER, "ts", "value", 480 * 3600, "view_value").select("event_id", r6(F.col("view_value")).alias("view_value"))


@query("""SELECT event_id, round(CASE WHEN count(value) OVER a >= 1.2 THEN avg(value) OVER a END, 6) AS value_mean24h, round(CASE WHEN count(value) OVER b >= 3.6 THEN avg(value) OVER b END, 6) AS value_mean72h FROM events
WINDOW a AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 259199999999 MICROSECONDS PRECEDING AND CURRENT ROW)""")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    w = temporal.window_features(events(spark, d), USER, "ts", "value", [24, 72], 0.05)
    return rounded(w.select("event_id", "value_mean24h", "value_mean72h"))


@query("""SELECT event_id, round(date_diff('microsecond', max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts), ts) / 3.6e9, 6) AS hours FROM events""")
def hours_since_error(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.select("event_id", r6(temporal.hours_since(e, USER, "ts", F.col("event_type") == "error")).alias("hours"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY 1), s AS (SELECT unnest(generate_series((SELECT min(hour) FROM h), (SELECT max(hour) FROM h), INTERVAL 1 HOUR)) AS hour)
SELECT s.hour, coalesce(n, 0) AS n, round(total, 6) AS total FROM s LEFT JOIN h USING (hour)""")
def hourly_spine(spark: SparkSession, d: str) -> DataFrame:
    h = events(spark, d).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    s = temporal.spine(h.agg(F.min("hour").alias("a"), F.max("hour").alias("b")), [], "a", "b", "1 HOUR", "hour")
    return s.join(h, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), r6(F.col("total")).alias("total"))


@query("""WITH near AS (SELECT a.event_id, a.user_id, a.value, median(b.value) AS m FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 45000 SECONDS AND b.ts <= a.ts + INTERVAL 45000 SECONDS GROUP BY ALL),
s AS (SELECT user_id, 1.4826 * median(abs(value - m)) AS s FROM near GROUP BY 1)
SELECT event_id, round(m, 6) AS running_median, abs(value - m) > 1 AND abs(value - m) > 5 * s AS outlier FROM near JOIN s USING (user_id)""")
def running_median_outliers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(temporal.running_median_outliers(events(spark, d), USER, "ts", "event_id", "value").select("event_id", "running_median", "outlier"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Successive events of a user as pairs with the change of value; null after more than 12 hours."""
    w = Window.partitionBy("user_id").orderBy("ts")
    p = events(spark, d).select("user_id", F.col("ts").alias("t1"), F.lead("ts").over(w).alias("t2"), (F.lead("value").over(w) - F.col("value")).alias("est"))
    return p.where("t2 IS NOT NULL").withColumn("est", F.when(F.unix_micros("t2") - F.unix_micros("t1") <= 43_200_000_000, F.col("est")))


_CHAIN = """WITH p AS (SELECT user_id, ts AS t1, lead(ts) OVER w AS t2, lead(value) OVER w - value AS est FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT * FROM p WHERE t2 IS NOT NULL AND date_diff('microsecond', t1, t2) <= 43200000000), n AS (SELECT *, CASE WHEN lag(t2) OVER (PARTITION BY user_id ORDER BY t1) = t1 THEN 0 ELSE 1 END AS nw FROM k),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t1 ROWS UNBOUNDED PRECEDING) - 1 AS seg FROM n),
c AS (SELECT user_id, t2 AS time, seg, sum(est) OVER (PARTITION BY user_id, seg ORDER BY t1 ROWS UNBOUNDED PRECEDING) AS est FROM s UNION ALL SELECT user_id, min(t1), seg, 0 FROM s GROUP BY user_id, seg)"""


@query(f"{_CHAIN} SELECT user_id, time, CAST(seg AS BIGINT) AS seg, round(est, 6) AS est FROM c")
def chain_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(islands.chain(pairs(spark, d), USER, "t1", "t2", "est"))


@query(f"""{_CHAIN}, g AS (SELECT user_id, seg, count(*) AS n, arg_max(est, time) AS last FROM c GROUP BY ALL)
SELECT user_id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS epochs, max(n) AS longest, round(sum(last), 6) AS net FROM g GROUP BY 1""")
def chain_scores(spark: SparkSession, d: str) -> DataFrame:
    g = islands.chain(pairs(spark, d), USER, "t1", "t2", "est").groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.max_by("est", "time").alias("last"))
    return rounded(g.groupBy("user_id").agg(F.count("*").alias("segments"), F.sum("n").alias("epochs"), F.max("n").alias("longest"), F.sum("last").alias("net")))


def user_days(spark: SparkSession, d: str) -> DataFrame:
    active = events(spark, d).select("user_id", F.to_date("ts").alias("day")).distinct()
    ends = active.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return temporal.spine(ends, USER, "a", "b", "1 DAY", "day").join(active.withColumn("active", F.lit(True)), ["user_id", "day"], "left")


_DAYS = """WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), e AS (SELECT user_id, min(day) AS a, max(day) AS b FROM a GROUP BY 1), s AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
f AS (SELECT s.user_id, s.day, a.day IS NOT NULL AS act FROM s LEFT JOIN a ON s.user_id = a.user_id AND s.day = a.day), r AS (SELECT *, sum(CASE WHEN p = act THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY day) - 1 AS run FROM (SELECT *, lag(act) OVER (PARTITION BY user_id ORDER BY day) AS p FROM f))"""


@query(f"{_DAYS} SELECT user_id, CAST(run AS BIGINT) AS run, min(day) AS first, max(day) AS last, count(*) AS n FROM r WHERE NOT act GROUP BY user_id, run HAVING count(*) >= 2")
def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return islands.runs_of(user_days(spark, d), USER, "day", F.col("active").isNull(), 2)


@query(f"{_DAYS}, g AS (SELECT user_id, run, min(day) AS first, max(day) AS last, count(*) AS n FROM r WHERE act GROUP BY ALL) SELECT user_id, first, last, n FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1")
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return islands.longest_run(islands.runs_of(user_days(spark, d), USER, "day", F.col("active")), USER)


@query("""SELECT event_id, round(step, 6) AS step FROM (SELECT event_id, value - lag(value) OVER w AS step, date_diff('microsecond', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE abs(step) > 40 AND gap <= 21600000000""")
def value_steps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(islands.steps(events(spark, d), USER, "ts", "value", 40, 21600).select("event_id", "step"))


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) < 21600000000 THEN 0 ELSE 1 END AS nw FROM events), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return islands.sessions(events(spark, d), USER, "ts", "6 hours")


@query("""WITH p AS (SELECT user_id, ts AS t1, lead(ts) OVER w AS t2, lead(value) OVER w - value AS est FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, t1, CASE WHEN date_diff('microsecond', t1, t2) <= 43200000000 THEN est END AS est FROM p WHERE t2 IS NOT NULL),
n AS (SELECT *, CASE WHEN lag(est) OVER (PARTITION BY user_id ORDER BY t1) IS NOT NULL AND est IS NOT NULL THEN 0 ELSE 1 END AS nw FROM k), s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t1 ROWS UNBOUNDED PRECEDING) - 1 AS run FROM n),
l AS (SELECT *, sum(est) OVER (PARTITION BY user_id, run ORDER BY t1 ROWS UNBOUNDED PRECEDING) AS lv, count(*) OVER (PARTITION BY user_id, run) AS c FROM s WHERE est IS NOT NULL)
SELECT user_id, t1, CAST(run AS BIGINT) AS run, round(lv - avg(lv) OVER (PARTITION BY user_id, run), 5) AS level FROM l WHERE c >= 4""")
def centred_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(islands.centred_runs(pairs(spark, d), USER, "t1", "est").select("user_id", "t1", "run", "level"), 5)


def scored_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Plot products of a series as pairs of levels (vv_db), with the water table as truth."""
    a = table(spark, d, "plots_acq").where("vv_db_3x3 IS NOT NULL AND wtd_at IS NOT NULL").groupBy(*SERIES, "track", "date").agg(F.min_by(F.struct("vv_db_3x3", "wtd_at"), "plot_acq_id").alias("x"))
    w = Window.partitionBy(*SERIES, "track").orderBy("date")
    p = a.select(*SERIES, "track", F.col("date").cast("timestamp").alias("t1"), F.lead("date").over(w).cast("timestamp").alias("t2"), (F.lead("x.vv_db_3x3").over(w) - F.col("x.vv_db_3x3")).alias("est_mm"), (F.lead("x.wtd_at").over(w) - F.col("x.wtd_at")).alias("truth_inc_mm"))
    truth = a.select(*SERIES, "track", F.col("date").cast("timestamp").alias("time"), F.col("x.wtd_at").alias("level"))
    return p.where("t2 IS NOT NULL"), truth


_SCORED = """WITH a AS (SELECT station, plot, track, date, vv_db_3x3 AS v, wtd_at AS h FROM plots_acq WHERE NOT isnan(vv_db_3x3) AND NOT isnan(wtd_at) QUALIFY row_number() OVER (PARTITION BY station, plot, track, date ORDER BY plot_acq_id) = 1),
p AS (SELECT station, plot, track, date AS t1, lead(date) OVER w AS t2, lead(v) OVER w - v AS est, lead(h) OVER w - h AS inc FROM a WINDOW w AS (PARTITION BY station, plot, track ORDER BY date)), q AS (SELECT * FROM p WHERE t2 IS NOT NULL)"""
_AGREE = """count(*) AS n, round(CASE WHEN count(*) > 2 AND stddev_pop(inc) > 1e-12 AND stddev_pop(est) > 1e-12 THEN corr(inc, est) END, 6) AS r, round(avg(est - inc), 6) AS bias, round(sqrt(avg((est - inc) ** 2)), 6) AS rmse,
round(sum(inc * est) / nullif(sum(inc * inc), 0), 6) AS slope_origin, round(avg(CASE WHEN abs(est - inc) < 55.465763 / 4 THEN 1.0 ELSE 0 END), 6) AS within"""


@query(f"{_SCORED} SELECT CASE WHEN month(t1) IN (12, 1, 2) THEN 'winter' WHEN month(t1) IN (3, 4, 5) THEN 'spring' WHEN month(t1) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, {_AGREE} FROM q GROUP BY 1")
def score_seasons(spark: SparkSession, d: str) -> DataFrame:
    p, _ = scored_pairs(spark, d)
    s = scoring.increments(p.withColumn("season", scalar.season(F.col("t1"))), ["season"], "truth_inc_mm", "est_mm")
    return rounded(s.select("season", "n", "r", "bias", "rmse", "slope_origin", "within"))


@query(f"{_SCORED} SELECT year(t1) AS year, {_AGREE} FROM q GROUP BY 1")
def score_years(spark: SparkSession, d: str) -> DataFrame:
    p, _ = scored_pairs(spark, d)
    s = scoring.increments(p.withColumn("year", F.year("t1").cast("long")), ["year"], "truth_inc_mm", "est_mm")
    return rounded(s.select("year", "n", "r", "bias", "rmse", "slope_origin", "within"))


@query()
def score_levels(spark: SparkSession, d: str) -> DataFrame:
    p, truth = scored_pairs(spark, d)
    return rounded(scoring.score(p, truth, [*SERIES, "track"], scoring.Protocol(["2021-01-01"], min_epochs=4))["levels"])


@query()
def score_winters(spark: SparkSession, d: str) -> DataFrame:
    p, truth = scored_pairs(spark, d)
    return rounded(scoring.score(p, truth, [*SERIES, "track"], scoring.Protocol(["2021-01-01"]))["winters"])


@query("""SELECT station, plot, CAST(time_utc AS DATE) AS date, round(avg(laser_surface_cm), 6) AS surface_cm, round(stddev_pop(laser_surface_cm), 4) AS surface_sd_cm, CAST(count(*) AS INTEGER) AS n_ok_hours
FROM site_hourly WHERE laser_ok AND laser_surface_cm IS NOT NULL AND NOT isnan(laser_surface_cm) GROUP BY ALL""")
def daily_truth(spark: SparkSession, d: str) -> DataFrame:
    t = gold.daily_truth(table(spark, d, "site_hourly"), SERIES, "time_utc", "laser_surface_cm", F.coalesce("laser_ok", F.lit(False)))
    return t.select(*SERIES, "date", r6(F.col("surface_cm")).alias("surface_cm"), F.round("surface_sd_cm", 4).alias("surface_sd_cm"), "n_ok_hours")


@query("""WITH s AS (SELECT station, plot, time_utc, arg_max(row_id, ingested_at) AS site_row FROM site_hourly GROUP BY ALL),
j AS (SELECT plot_acq_id, site_row, date_diff('microsecond', a.time_utc, s.time_utc) AS dus, row_number() OVER (PARTITION BY plot_acq_id ORDER BY abs(date_diff('microsecond', a.time_utc, s.time_utc)), s.time_utc) AS n FROM plots_acq a JOIN s ON a.station = s.station AND a.plot = s.plot AND abs(date_diff('microsecond', a.time_utc, s.time_utc)) <= 1860000000)
SELECT a.plot_acq_id, j.site_row, round(dus / 3.6e9, 6) AS site_lag_h FROM plots_acq a LEFT JOIN j ON a.plot_acq_id = j.plot_acq_id AND n = 1""")
def site_at_overpass(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_hourly").groupBy(*SERIES, "time_utc").agg(F.max_by("row_id", "ingested_at").alias("row"))
    a = table(spark, d, "plots_acq").select("plot_acq_id", *SERIES, "time_utc")
    return gold.with_site(a, s, SERIES, "time_utc", ["row"]).select("plot_acq_id", F.col("site_row"), r6(F.col("site_lag_h")).alias("site_lag_h"))


_SCENES = "WITH a AS (SELECT station, plot, track, date, vv_db_3x3 AS v FROM plots_acq QUALIFY row_number() OVER (PARTITION BY station, plot, track, date ORDER BY plot_acq_id) = 1)"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "plots_acq").groupBy(*SERIES, "track", "date").agg(F.min_by(F.struct("vv_db_3x3", "air_c"), "plot_acq_id").alias("x")).select(*SERIES, "track", "date", "x.*")


@query(f"{_SCENES} SELECT station, plot, track, date AS t1, lead(date) OVER w AS t2, CAST(lead(date) OVER w - date AS INTEGER) AS revisit_days, round(CASE WHEN NOT isnan(v) THEN lead(v) OVER w - v END, 6) AS d_vv_db_3x3 FROM a WINDOW w AS (PARTITION BY station, plot, track ORDER BY date) QUALIFY t2 IS NOT NULL")
def acquisition_changes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gold.pair_changes(scenes(spark, d), [*SERIES, "track"], "date", ["vv_db_3x3"]))


@query(f"""{_SCENES} SELECT p.station, p.plot, p.track, p.date AS t1, CAST(p.date + 12 AS DATE) AS t2, round(b.v - p.v, 6) AS d_vv FROM a p LEFT JOIN a b ON b.station = p.station AND b.plot = p.plot AND b.track = p.track AND b.date = p.date + 12""")
def backscatter_change(spark: SparkSession, d: str) -> DataFrame:
    s = scenes(spark, d)
    p = s.select(*SERIES, "track", F.col("date").alias("t1"), F.date_add("date", 12).alias("t2"))
    return rounded(gold.change_between(p, s, [*SERIES, "track"], "t1", "t2", "date", "vv_db_3x3", "d_vv").select(*SERIES, "track", "t1", "t2", "d_vv"))


@query("""WITH c AS (SELECT DISTINCT px_row, px_col, station || '/' || plot AS p FROM plots_acq), u AS (SELECT px_row, px_col, array_to_string(list(p ORDER BY p), '+') AS unit FROM c GROUP BY ALL) SELECT px_row, px_col, unit FROM u""")
def plot_units(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "plots_acq").select("px_row", "px_col", F.concat_ws("/", "station", "plot").alias("p"))
    return gold.units(p, "px_row", "px_col", "p").select("px_row", "px_col", "unit").distinct()


def rain_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily rain and mean air temperature of every series, on a full calendar."""
    s = table(spark, d, "site_hourly").groupBy(*SERIES, F.to_date("time_utc").alias("day")).agg(F.sum("rain_mm").alias("rain"), F.avg("air_c").alias("air"), F.max("air_c").alias("tmax"), F.min("air_c").alias("tmin"))
    ends = s.groupBy(*SERIES).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return temporal.spine(ends, SERIES, "a", "b", "1 DAY", "day").join(s, [*SERIES, "day"], "left")


_RAIN = """WITH RECURSIVE h AS (SELECT station, plot, CAST(time_utc AS DATE) AS day, CASE WHEN isnan(rain_mm) THEN NULL ELSE rain_mm END AS r, CASE WHEN isnan(air_c) THEN NULL ELSE air_c END AS t FROM site_hourly),
s AS (SELECT station, plot, day, sum(r) AS rain, avg(t) AS air, max(t) AS tmax, min(t) AS tmin FROM h GROUP BY ALL), e AS (SELECT station, plot, min(day) AS a, max(day) AS b FROM s GROUP BY ALL),
c AS (SELECT station, plot, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM e), f AS (SELECT c.station, c.plot, c.day, rain, air, tmax, tmin, row_number() OVER (PARTITION BY c.station, c.plot ORDER BY c.day) AS i FROM c LEFT JOIN s ON c.station = s.station AND c.plot = s.plot AND c.day = s.day)"""


@query(f"""{_RAIN}, x AS (SELECT station, plot, day, i, 0.0::DOUBLE AS api FROM f WHERE i = 1 UNION ALL SELECT f.station, f.plot, f.day, f.i, 0.9 * x.api + coalesce(f.rain, 0) FROM x JOIN f ON f.station = x.station AND f.plot = x.plot AND f.i = x.i + 1)
SELECT station, plot, day, round(api, 5) AS api FROM x""")
def antecedent_precipitation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.antecedent_precipitation(rain_days(spark, d), SERIES, "day", "rain").select(*SERIES, "day", "api"), 5)


@query(f"""{_RAIN}, x AS (SELECT station, plot, day, i, (1 - exp(-0.1)) * coalesce(rain, 0) AS m FROM f WHERE i = 1 UNION ALL SELECT f.station, f.plot, f.day, f.i, exp(-0.1) * x.m + (1 - exp(-0.1)) * coalesce(f.rain, 0) FROM x JOIN f ON f.station = x.station AND f.plot = x.plot AND f.i = x.i + 1)
SELECT station, plot, day, round(m, 5) AS memory FROM x""")
def exponential_memory(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.exponential_memory(rain_days(spark, d), SERIES, "day", "rain", 10.0).select(*SERIES, "day", "memory"), 5)


@query(f"""{_RAIN}, x AS (SELECT station, plot, i, day, greatest(5 + 0.8 * coalesce(rain, 0) - 0.5 * coalesce(greatest(air, 0), 0) - 0.05 * 5, 0) AS w FROM f WHERE i = 1 UNION ALL
SELECT f.station, f.plot, f.i, f.day, greatest(x.w + 0.8 * coalesce(f.rain, 0) - 0.5 * coalesce(greatest(f.air, 0), 0) - 0.05 * x.w, 0) FROM x JOIN f ON f.station = x.station AND f.plot = x.plot AND f.i = x.i + 1)
SELECT station, plot, day, round(w, 5) AS level FROM x""")
def bucket_levels(spark: SparkSession, d: str) -> DataFrame:
    days = rain_days(spark, d).withColumn("warm", F.greatest("air", F.lit(0.0)) + 0 * F.col("air"))
    return rounded(hydro.bucket(days, SERIES, "day", "rain", "warm", 5.0, 0.8, 0.5, 0.05, 0.0), 5)


@query(f"""{_RAIN}, g AS (SELECT *, 0.3 * sum(coalesce(rain, 0)) OVER w - 0.2 * sum(coalesce(air, 0)) OVER w AS rr FROM f WINDOW w AS (PARTITION BY station, plot ORDER BY day ROWS 9 PRECEDING)), k AS (SELECT *, CASE WHEN i >= 10 THEN rr END AS rev FROM g)
SELECT station, plot, day, round(rev, 5) AS reversible, CAST(sum(CASE WHEN rev <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY station, plot ORDER BY day) AS BIGINT) AS dry_days FROM k""")
def soil_motion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hydro.reversible(rain_days(spark, d), SERIES, "day", "rain", "air", 0.3, 0.2, 10).select(*SERIES, "day", "reversible", "dry_days"), 5)


@query(f"""{_RAIN} SELECT f.station, f.plot, f.day,
round(24 / pi() * acos(greatest(-1, least(1, -tan(radians(lat)) * tan(0.409 * sin(2 * pi() * dayofyear(day) / 365 - 1.39))))), 5) AS day_length_h,
round(CASE WHEN air > 0 THEN 0.1651 * (24 / pi() * acos(greatest(-1, least(1, -tan(radians(lat)) * tan(0.409 * sin(2 * pi() * dayofyear(day) / 365 - 1.39))))) / 12) * (216.7 * 0.6108 * exp(17.27 * air / (air + 237.3)) * 10 / (air + 273.3)) WHEN air IS NOT NULL THEN 0 END, 5) AS hamon,
CASE WHEN round(rain * 20, 6) < 50 THEN 'extremely dry' WHEN round(rain * 20, 6) < 75 THEN 'very dry' WHEN round(rain * 20, 6) < 90 THEN 'dry' WHEN round(rain * 20, 6) < 110 THEN 'normal' WHEN round(rain * 20, 6) < 125 THEN 'wet' WHEN round(rain * 20, 6) < 150 THEN 'very wet' WHEN rain IS NOT NULL THEN 'extremely wet' END AS rain_class
FROM f JOIN stations USING (station)""")
def evaporation(spark: SparkSession, d: str) -> DataFrame:
    days = rain_days(spark, d).join(table(spark, d, "stations").select("station", "lat"), "station")
    doy, lat = F.dayofyear("day"), F.col("lat")
    return rounded(days.select(*SERIES, "day", hydro.day_length_h(doy, lat).alias("day_length_h"), hydro.hamon_pet(F.col("air"), doy, lat).alias("hamon"), hydro.rain_class(F.round(F.col("rain") * 20, 6)).alias("rain_class")), 5)


@query("""WITH s AS (SELECT station, plot, time_utc, arg_max(CASE WHEN isnan(air_c) THEN NULL ELSE air_c END, ingested_at) AS air FROM site_hourly GROUP BY ALL)
SELECT station, plot, time_utc, avg(air) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 431999999999 MICROSECONDS PRECEDING AND CURRENT ROW) < 0 AS frozen FROM s""")
def freeze_flags(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "site_hourly").groupBy(*SERIES, "time_utc").agg(F.max_by("air_c", F.when(F.col("air_c").isNotNull(), F.col("ingested_at"))).alias("air"))
    return hydro.freeze_flags(s, SERIES, "time_utc", "air").select(*SERIES, "time_utc", "frozen")


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1), l AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY 1), k AS (SELECT unnest([0, 7, 14, 21, 28]) AS lag),
j AS (SELECT lag, total, q FROM o CROSS JOIN k JOIN l ON l.day = o.day - CAST(lag AS INTEGER)), g AS (SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n, corr(q, total) AS r FROM j GROUP BY 1 HAVING count(*) >= 6)
SELECT lag, n, round(r, 6) AS r, row_number() OVER (ORDER BY round(abs(r), 9) DESC, lag) = 1 AS best FROM g""")
def lag_scan(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    q = table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    return rounded(hydro.lag_correlation(o, q, "day", "total", "q", [0, 7, 14, 21, 28]))
