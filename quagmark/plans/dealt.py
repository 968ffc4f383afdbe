"""Queries pN_... of the general problems 2 to 5 over a data folder, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quagmark.operators import regular, spikes, trailing
from quagmark.operators import timestamps as ts
from quagmark.session import checkpointed
from quagmark.sources.tables import table


def instants(spark: SparkSession, d: str, tabs: tuple[str, ...] = ("s1_acquisitions", "laser_flags", "interpolated"), least_margin: float = ts.CONVENTION_MARGIN) -> DataFrame:
    """The UTC instants of the text stamps of the three tables, under the conventions of each."""
    places = table(spark, d, "stations").select("station", "tz", "date_order")
    placed = lambda name, *columns: table(spark, d, name).select("station", "plot", *columns).join(places, "station", "left")
    source = ["station", "plot"]
    known = {
        "s1_acquisitions": lambda: ts.stamps(placed("s1_acquisitions", "acq_id", "overpass_utc", "date"), "s1_acquisitions", "acq_id", "overpass_utc", source, F.lit("UTC"), F.col("tz"), F.col("date_order"), F.col("date")),
        "laser_flags": lambda: ts.stamps(placed("laser_flags", "flag_id", "time_utc", "clock"), "laser_flags", "flag_id", "time_utc", source, F.coalesce("clock", "tz"), F.col("tz"), F.col("date_order")),
        "interpolated": lambda: ts.stamps(placed("interpolated", "interp_id", "start"), "interpolated", "interp_id", "start", source, F.col("tz"), F.col("tz"), F.col("date_order")),
    }
    return ts.resolve(*(known[t]() for t in tabs), least_margin=least_margin)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants(spark, d).where("decided").select("tab", "rec_id", F.floor(F.col("epoch_us") / 1000).cast("long").alias("epoch_ms"))


def p2_notations(spark: SparkSession, d: str) -> DataFrame:
    """How often each notation occurs in each table, and how many of its stamps are decided."""
    return instants(spark, d).groupBy("tab", "notation").agg(F.count("*").alias("n"), F.count_if("decided").alias("n_decided"))


def p2_settled(spark: SparkSession, d: str) -> DataFrame:
    """The stamps that the conventions leave open and the order of a source's records settles, with the number of instants to choose from."""
    return instants(spark, d, least_margin=ts.ORDER_MARGIN).where("decided AND n_readings > 1").select("tab", "rec_id", F.floor(F.col("epoch_us") / 1000).cast("long").alias("epoch_ms"), "n_readings")


SERIES = ["station", "plot"]
RAIN = {"rain_24h_mm": 1, "rain_72h_mm": 3, "rain_7d_mm": 7, "rain_30d_mm": 30}
#: Millionths of a mm by which a stored total must differ.
RAIN_TOLERANCE = 50_000


def _hours(spark: SparkSession, d: str, stored: bool) -> DataFrame:
    site = table(spark, d, "site_hourly")
    fields = [trailing.amount("rain_mm").alias("rain"), F.col("snow_evidence").alias("snow")]
    if stored:
        fields += [*(trailing.amount(f).alias(f) for f in RAIN), F.col("laser_snow_72h")]
    return trailing.latest_hours(site, SERIES, "time_utc", "ingested_at", "row_id", fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The stored trailing values that contradict the series' own hourly record."""
    right = trailing.trailing_hours(_hours(spark, d, True), SERIES, "rain", "snow", list(RAIN.values()), 3)
    wrong = [F.when(F.abs(F.col(f"hour.{f}") - F.col(f"total_{p}d")) >= RAIN_TOLERANCE, F.lit(f)) for f, p in RAIN.items()]
    wrong.append(F.when(F.col("hour.laser_snow_72h") != F.col("flagged"), F.lit("laser_snow_72h")))
    return right.select(F.col("hour.row_id").alias("row_id"), F.explode(F.array_compact(F.array(*wrong))).alias("field"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rain and hours of snow over the trailing 7 and 30 days for every series and day, days without rows included."""
    days = _hours(spark, d, False)
    zero = F.lit(0).cast("long")
    daily = days.select(
        *SERIES, "day",
        F.aggregate("hours", zero, lambda a, x: a + F.coalesce(x["rain"], zero)).alias("rain"),
        F.aggregate("hours", zero, lambda a, x: a + F.coalesce(x["snow"], F.lit(False)).cast("long")).alias("snow"),
    )
    t = trailing.trailing_totals(daily, SERIES, "day", ["rain", "snow"], [7, 30])
    mm = lambda c, n: F.round(F.col(c) / (trailing.UNIT * n), 3)
    return t.select(
        *SERIES, "day", mm("rain_7d", 1).alias("rain_7d_mm"), mm("rain_30d", 1).alias("rain_30d_mm"),
        mm("rain_7d", 7).alias("rain_7d_mean_mm"), mm("rain_30d", 30).alias("rain_30d_mean_mm"), F.col("snow_7d").alias("snow_7d_h"), F.col("snow_30d").alias("snow_30d_h"),
    )


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    """The full daily level series: usable value, value carried forward for up to 7 days, mark."""
    usable = F.col("surface_cm").between(-100, 100) & F.col("n_ok_hours").between(1, 24)
    refill = regular.days_with(table(spark, d, "site_hourly"), SERIES, "time_utc", "ingested_at", F.col("laser_ok") & F.col("laser_surface_cm").isNotNull())
    return regular.daily_grid(table(spark, d, "laser_daily"), SERIES, "date", "published_at", "surface_cm", ["n_ok_hours"], usable, refill, 7)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_series(spark, d).where("mark <> 'ok'").select("station", "plot", F.date_format("day", "yyyy-MM-dd").alias("day"), "mark")


def p5_states(spark: SparkSession, d: str) -> DataFrame:
    """The readings that the model flags as unlike their series, with their state, and whether the exact rule says so too."""
    found = spikes.implausible(table(spark, d, "laser_hourly"), SERIES, "time_utc", "reading_id", ["surface_cm_raw", "surface_cm"], checkpointed)
    return found.select(*SERIES, "field", F.col("rec_id").alias("reading_id"), "state", "p", "rule")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The readings that the model flags, as far as the exact rule agrees."""
    return p5_states(spark, d).where("rule").select("reading_id", "field")


_LATEST_HOURS = """latest AS (SELECT * FROM site_hourly QUALIFY row_number() OVER (PARTITION BY station, plot, time_utc ORDER BY ingested_at DESC, row_id DESC) = 1)"""

_P3_FOUND = f"""WITH {_LATEST_HOURS},
hours AS (SELECT *, CASE WHEN isnan(rain_mm) THEN NULL ELSE rain_mm END AS r FROM latest),
w AS (SELECT *,
  coalesce(sum(CAST(r AS DECIMAL(18,6))) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW), 0) AS r24,
  coalesce(sum(CAST(r AS DECIMAL(18,6))) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 71 HOURS PRECEDING AND CURRENT ROW), 0) AS r72,
  coalesce(sum(CAST(r AS DECIMAL(18,6))) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 167 HOURS PRECEDING AND CURRENT ROW), 0) AS r168,
  coalesce(sum(CAST(r AS DECIMAL(18,6))) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 719 HOURS PRECEDING AND CURRENT ROW), 0) AS r720,
  coalesce(bool_or(snow_evidence) OVER (PARTITION BY station, plot ORDER BY time_utc RANGE BETWEEN INTERVAL 71 HOURS PRECEDING AND CURRENT ROW), false) AS s72
  FROM hours)
SELECT row_id, 'rain_24h_mm' AS field FROM w WHERE NOT isnan(rain_24h_mm) AND abs(CAST(rain_24h_mm AS DECIMAL(18,6)) - r24) >= 0.05
UNION ALL SELECT row_id, 'rain_72h_mm' FROM w WHERE NOT isnan(rain_72h_mm) AND abs(CAST(rain_72h_mm AS DECIMAL(18,6)) - r72) >= 0.05
UNION ALL SELECT row_id, 'rain_7d_mm' FROM w WHERE NOT isnan(rain_7d_mm) AND abs(CAST(rain_7d_mm AS DECIMAL(18,6)) - r168) >= 0.05
UNION ALL SELECT row_id, 'rain_30d_mm' FROM w WHERE NOT isnan(rain_30d_mm) AND abs(CAST(rain_30d_mm AS DECIMAL(18,6)) - r720) >= 0.05
UNION ALL SELECT row_id, 'laser_snow_72h' FROM w WHERE laser_snow_72h <> s72"""

_P3_TOTALS = f"""WITH {_LATEST_HOURS},
daily AS (SELECT station, plot, CAST(time_utc AS DATE) AS day, coalesce(sum(CAST(CASE WHEN isnan(rain_mm) THEN NULL ELSE rain_mm END AS DECIMAL(18,6))), 0) AS rain, count(*) FILTER (snow_evidence) AS snow FROM latest GROUP BY ALL),
ends AS (SELECT station, plot, min(day) AS a, max(day) AS b FROM daily GROUP BY station, plot),
spine AS (SELECT station, plot, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
f AS (SELECT station, plot, day, coalesce(rain, 0) AS rain, coalesce(snow, 0) AS snow FROM spine LEFT JOIN daily USING (station, plot, day)),
w AS (SELECT station, plot, day,
  sum(rain) OVER (PARTITION BY station, plot ORDER BY day ROWS 6 PRECEDING) AS r7, sum(rain) OVER (PARTITION BY station, plot ORDER BY day ROWS 29 PRECEDING) AS r30,
  sum(snow) OVER (PARTITION BY station, plot ORDER BY day ROWS 6 PRECEDING) AS s7, sum(snow) OVER (PARTITION BY station, plot ORDER BY day ROWS 29 PRECEDING) AS s30 FROM f)
SELECT station, plot, day, round(CAST(r7 AS DOUBLE), 3) AS rain_7d_mm, round(CAST(r30 AS DOUBLE), 3) AS rain_30d_mm, round(CAST(r7 AS DOUBLE) / 7, 3) AS rain_7d_mean_mm,
  round(CAST(r30 AS DOUBLE) / 30, 3) AS rain_30d_mean_mm, CAST(s7 AS BIGINT) AS snow_7d_h, CAST(s30 AS BIGINT) AS snow_30d_h FROM w"""

_P4 = f"""WITH {_LATEST_HOURS},
can AS (SELECT DISTINCT station, plot, CAST(time_utc AS DATE) AS day FROM latest WHERE laser_ok AND laser_surface_cm IS NOT NULL AND NOT isnan(laser_surface_cm)),
versions AS (SELECT station, plot, date, CASE WHEN isnan(surface_cm) THEN NULL ELSE surface_cm END AS surface_cm, n_ok_hours FROM laser_daily
  QUALIFY row_number() OVER (PARTITION BY station, plot, date ORDER BY published_at DESC) = 1),
ends AS (SELECT station, plot, min(date) AS a, max(date) AS b FROM laser_daily GROUP BY station, plot),
spine AS (SELECT station, plot, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ends),
f AS (SELECT s.station, s.plot, s.day, CASE WHEN v.surface_cm BETWEEN -100 AND 100 AND v.n_ok_hours BETWEEN 1 AND 24 THEN v.surface_cm END AS value, c.day IS NOT NULL AS refill
  FROM spine s LEFT JOIN versions v ON v.station = s.station AND v.plot = s.plot AND v.date = s.day LEFT JOIN can c ON c.station = s.station AND c.plot = s.plot AND c.day = s.day),
g AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS carried, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER w AS since FROM f
  WINDOW w AS (PARTITION BY station, plot ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_notations": p2_notations, "p2_settled": p2_settled, "p3_found": p3_found, "p3_totals": p3_totals, "p4_found": p4_found, "p4_series": p4_series, "p5_found": p5_found, "p5_states": p5_states}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _P3_FOUND,
        "p3_totals": _P3_TOTALS,
        "p4_found": f"{_P4} SELECT station, plot, strftime(day, '%Y-%m-%d') AS day, CASE WHEN refill THEN 'refill' ELSE 'gap' END AS mark FROM g WHERE value IS NULL",
        "p4_series": f"{_P4} SELECT station, plot, day, value, CASE WHEN day - since <= 7 THEN carried END AS filled, CASE WHEN value IS NOT NULL THEN 'ok' WHEN refill THEN 'refill' ELSE 'gap' END AS mark FROM g",
    }
