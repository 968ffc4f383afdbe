"""Queries of statistics, resampling, circular means, relational basics, contracts and scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quagmark.functions import scalar
from quagmark.operators import circular, contracts, kernels, resample, stats
from quagmark.plans.book import query, r6, rounded
from quagmark.sources.tables import table

TURN = 2 * math.pi


def _p_sql(z: str) -> str:
    """The two-sided p of a normal z in SQL, by the series of ``stats.normal_cdf``."""
    t = f"(1 / (1 + 0.3275911 * (({z}) / sqrt(2.0))))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2))"


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Quantity and revenue per month."""
    return lineitem(spark, d).groupBy(F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("x"), F.avg("l_discount").alias("disc"))


_MONTHLY = "WITH mo AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, sum(l_quantity) AS q, sum(l_extendedprice) AS x, avg(l_discount) AS disc FROM lineitem GROUP BY 1)"


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
round((var_samp(l_extendedprice) - var_samp(l_quantity) + sqrt((var_samp(l_extendedprice) - var_samp(l_quantity)) ** 2 + 4 * covar_samp(l_quantity, l_extendedprice) ** 2)) / (2 * covar_samp(l_quantity, l_extendedprice)), 4) AS tls,
round(sign(covar_samp(l_quantity, l_extendedprice)) * sqrt(var_samp(l_extendedprice) / var_samp(l_quantity)), 5) AS rma, round(sum(l_quantity * l_extendedprice) / sum(l_quantity * l_quantity), 5) AS slope_origin,
round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def regression_lines(spark: SparkSession, d: str) -> DataFrame:
    g = stats.lines(lineitem(spark, d), ["l_returnflag"], "l_quantity", "l_extendedprice")
    digits = {"slope": 5, "intercept": 4, "tls": 4, "rma": 5, "slope_origin": 5, "r": 6, "r2": 6}
    return g.select("l_returnflag", "n", *(F.round(c, k).alias(c) for c, k in digits.items()))


# the yearly cycle by partial regression: the trend is taken out of all columns first, which leaves two equations
_YEARLY = """WITH b AS (SELECT o_orderpriority AS k, (epoch_us(CAST(o_orderdate AS TIMESTAMP)) - epoch_us(TIMESTAMP '1995-01-01')) / (365.25 * 86400 * 1e6) AS t, o_totalprice AS y FROM orders), x AS (SELECT *, cos(2 * pi() * t) AS c, sin(2 * pi() * t) AS s FROM b WHERE y IS NOT NULL),
m AS (SELECT k, avg(t) AS mt, avg(c) AS mc, avg(s) AS ms, avg(y) AS my, regr_slope(c, t) AS bc, regr_slope(s, t) AS bs, regr_slope(y, t) AS bt FROM x GROUP BY 1),
r AS (SELECT k, bc, bs, bt, y - my AS y0, c - mc - bc * (t - mt) AS c, s - ms - bs * (t - mt) AS s, y - my - bt * (t - mt) AS y FROM x JOIN m USING (k)),
q AS (SELECT k, any_value(bc) AS bc, any_value(bs) AS bs, any_value(bt) AS bt, count(*) AS n, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss, sum(c * y) AS cy, sum(s * y) AS sy, sum(y * y) AS yy, sum(y0 * y0) AS tt FROM r GROUP BY 1),
f AS (SELECT *, cc * ss - cs * cs AS det, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b FROM q)"""


def _years():
    return scalar.years_since(F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp"))


@query(f"""{_YEARLY} SELECT k AS o_orderpriority, n, round(sqrt(a * a + b * b), 3) AS amplitude, round((atan2(b, a) / (2 * pi()) + CASE WHEN atan2(b, a) < 0 THEN 1 ELSE 0 END) * 365.25, 3) AS phase_doy, round(bt - a * bc - b * bs, 3) AS trend, round(1 - (yy - a * cy - b * sy) / tt, 3) AS r2 FROM f""")
def annual_harmonic(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.harmonic(table(spark, d, "orders"), ["o_orderpriority"], _years(), F.col("o_totalprice")), 3)


@query(f"""{_YEARLY}, v AS (SELECT *, (yy - a * cy - b * sy) / (n - 4) / det AS u FROM f) SELECT k AS o_orderpriority, n, round(a, 3) AS cos, round(b, 3) AS sin, round(u * ss, 0) AS cc, round(u * cc, 0) AS ss, round(-u * cs, 0) AS cs FROM v""")
def harmonic_parts(spark: SparkSession, d: str) -> DataFrame:
    h = stats.harmonic_covariance(table(spark, d, "orders"), ["o_orderpriority"], _years(), F.col("o_totalprice"))
    return h.select("o_orderpriority", "n", F.round("cos", 3).alias("cos"), F.round("sin", 3).alias("sin"), *(F.round(c, 0).alias(c) for c in ("cc", "ss", "cs")))


@query(f"{_MONTHLY}, t AS (SELECT *, CAST(m - DATE '1995-01-01' AS DOUBLE) AS t FROM mo), k AS (SELECT regr_slope(q, t) AS s, regr_intercept(q, t) AS i FROM t) SELECT m, round(q - i - s * t, 4) AS residual FROM t, k")
def detrended_months(spark: SparkSession, d: str) -> DataFrame:
    t = monthly(spark, d).withColumns({"t": F.datediff("m", F.lit("1995-01-01").cast("date")).cast("double"), "one": F.lit(1)})
    return rounded(stats.detrended(t, ["one"], "t", "q", "residual").select("m", "residual"), 4)


@query("""WITH g AS (SELECT year(l_shipdate) AS year, sum(l_quantity * l_extendedprice) AS xy, sum(l_quantity * l_quantity) AS xx, count(*) AS n FROM lineitem GROUP BY 1)
SELECT year, round((sum(xy) OVER () - xy) / nullif(sum(xx) OVER () - xx, 0), 5) AS slope FROM g""")
def leave_year_out(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).withColumn("year", F.year("l_shipdate").cast("long"))
    return rounded(stats.leave_one_group_out_slope(li, "year", "l_quantity", "l_extendedprice"), 5)


@query(f"""{_MONTHLY}, s AS (SELECT m, q, disc, count(*) OVER () - 1 AS n, sum(q) OVER () - q AS sy, sum(disc) OVER () - disc AS sx, sum(disc * disc) OVER () - disc * disc AS sxx, sum(disc * q) OVER () - disc * q AS sxy FROM mo)
SELECT m, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n + (n * sxy - sx * sy) / (n * sxx - sx * sx) * disc, 3) AS loo FROM s""")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.leave_one_out_line(monthly(spark, d), "disc", "q").select("m", "loo"), 3)


@query("""WITH g AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem GROUP BY 1) SELECT l_returnflag, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) AS partial_r FROM g""")
def partial_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.partial_r(lineitem(spark, d), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_tax"))


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS b FROM events)
SELECT event_type, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id"))


@query(f"""WITH r AS (SELECT event_type, user_id % 2 = 0 AS f, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events),
t AS (SELECT event_type, sum(c * (c * c - 1)) AS ties FROM (SELECT event_type, value, count(*)::DOUBLE AS c FROM r GROUP BY ALL) GROUP BY 1),
g AS (SELECT event_type, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u FROM r GROUP BY 1),
z AS (SELECT *, greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM g JOIN t USING (event_type))
SELECT event_type, n1, n2, round(u, 4) AS u, round({_p_sql('z')}, 4) AS p FROM z""")
def mann_whitney(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.mann_whitney(table(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 2 == 0), 4)


@query(f"""WITH x AS (SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) - sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS delta FROM lineitem GROUP BY 1), r AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS r FROM x WHERE delta <> 0),
t AS (SELECT sum(c * (c * c - 1)) AS ties FROM (SELECT abs(delta), count(*)::DOUBLE AS c FROM r GROUP BY 1)), g AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS w_minus FROM r),
z AS (SELECT *, abs(w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM g, t)
SELECT CAST(n AS BIGINT) AS n, round(w_plus, 3) AS w_plus, round(w_minus, 3) AS w_minus, round({_p_sql('z')}, 3) AS p FROM z""")
def wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    q = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0))
    x = lineitem(spark, d).groupBy("l_orderkey").agg((q("R") - q("A")).alias("delta"))
    return rounded(stats.wilcoxon(x, [], "delta"), 3)


@query(f"""WITH y AS (SELECT o_orderstatus, (year(o_orderdate) * 12 + month(o_orderdate))::DOUBLE AS x, avg(o_totalprice) AS y FROM orders GROUP BY ALL), c AS (SELECT o_orderstatus, count(*)::DOUBLE AS n, median(x) AS mx, median(y) AS my FROM y GROUP BY 1),
p AS (SELECT a.o_orderstatus, (b.y - a.y) / (b.x - a.x) AS s, sign(b.y - a.y) AS k FROM y a JOIN y b ON a.o_orderstatus = b.o_orderstatus AND b.x > a.x), q AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS nt FROM p),
h AS (SELECT q.*, n, mx, my, 1.959964 * sqrt(n * (n - 1) * (2 * n + 5) / 18) AS half FROM q JOIN c USING (o_orderstatus)),
g AS (SELECT o_orderstatus, median(s) AS slope, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum(k) AS sk, count(*) AS pairs, max(s) FILTER (i = greatest(round_even((nt - half) / 2, 0) - 1, 0)) AS low, max(s) FILTER (i = least(round_even((nt + half) / 2, 0), nt - 1)) AS high FROM h GROUP BY 1)
SELECT o_orderstatus, round(slope, 3) AS slope, round(my - slope * mx, 1) AS intercept, round(low, 3) AS low, round(high, 3) AS high, round(sk / (n * (n - 1) / 2), 6) AS tau, round({_p_sql('abs(sk) / sqrt(n * (n - 1) * (2 * n + 5) / 18)')}, 4) AS p, pairs FROM g WHERE n > 33""")
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy("o_orderstatus", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("x")).agg(F.avg("o_totalprice").alias("y"))
    # shorter series have an exact p, which SQL has not
    long = y.join(y.groupBy("o_orderstatus").agg(F.count("*").alias("n")).where("n > 33"), "o_orderstatus")
    t = stats.theil_sen(long, ["o_orderstatus"], "x", "y")
    digits = {"slope": 3, "intercept": 1, "low": 3, "high": 3, "tau": 6, "p": 4}
    return t.select("o_orderstatus", *(F.round(c, k).alias(c) for c, k in digits.items()), "pairs")


@query("""WITH e AS (SELECT event_type, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM events GROUP BY 1), b AS (SELECT event_type, value, user_id, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) - 1 AS bin FROM events JOIN e USING (event_type)),
q AS (SELECT event_type, bin, median(value) AS mx, quantile_cont(user_id, 0.9) AS qy FROM b GROUP BY 1, 2) SELECT event_type, count(*) AS bins, round(regr_slope(qy, mx), 6) AS slope FROM q GROUP BY 1""")
def upper_envelope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.envelope_slope(table(spark, d, "events"), ["event_type"], "value", "user_id", 5, 0.9))


@query("SELECT p_brand, CAST(t AS INTEGER) AS quarter, count(*) AS n, min(p_retailprice) AS low FROM (SELECT p_brand, p_retailprice, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS t FROM part) GROUP BY ALL")
def price_quarters(spark: SparkSession, d: str) -> DataFrame:
    t = F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey"))
    return table(spark, d, "part").withColumn("quarter", t).groupBy("p_brand", "quarter").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"))


@query("""WITH p AS (SELECT event_id, event_type, value / 100 AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM p)
SELECT event_id, round(least(1.0, min(p * m / k) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM k""")
def false_discovery(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select("event_id", "event_type", (F.col("value") / 100).alias("p"))
    return rounded(stats.bh_qvalues(p, ["event_type"], "p").select("event_id", "q"), 9)


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS md FROM lineitem GROUP BY 1) SELECT l_returnflag, round(any_value(md), 4) AS median, round(1.4826 * median(abs(l_extendedprice - md)), 4) AS robust_sd, count(*) AS n FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.robust_sd(lineitem(spark, d), ["l_returnflag"], "l_extendedprice"), 4)


@query("""WITH c AS (SELECT l_linestatus, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER (PARTITION BY l_linestatus) AS t FROM lineitem)
SELECT l_linestatus, round((min(x) FILTER (c >= t / 2) + min(x) FILTER (c > t / 2)) / 2, 4) AS weighted_median FROM c GROUP BY 1""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.weighted_median(lineitem(spark, d), ["l_linestatus"], "l_extendedprice", "l_quantity"), 4)


@query("SELECT p_brand, p_size AS mode, n FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1")
def smallest_mode(spark: SparkSession, d: str) -> DataFrame:
    return stats.smallest_mode(table(spark, d, "part"), ["p_brand"], "p_size")


@query("""WITH m AS (SELECT l_shipdate, l_returnflag, l_quantity * 1000 AS t, l_extendedprice AS e FROM lineitem), a AS (SELECT l_returnflag, avg(t) AS mt FROM m GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(corr(t, e), 6) AS r, round(avg(e - t), 3) AS bias, round(sqrt(avg((e - t) ** 2)), 3) AS rmse, round(sum(t * e) / sum(t * t), 6) AS slope_origin, round(1 - sum((e - t) ** 2) / sum((t - mt) ** 2), 5) AS nse, round(stddev_pop(e) / stddev_pop(t), 6) AS amplitude_ratio FROM m JOIN a USING (l_returnflag) GROUP BY 1""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    m = lineitem(spark, d).select("l_returnflag", (F.col("l_quantity") * 1000).alias("t"), F.col("l_extendedprice").alias("e"))
    g = stats.agreement(m, ["l_returnflag"], "t", "e")
    return g.select("l_returnflag", "n", r6(F.col("r")).alias("r"), F.round("bias", 3).alias("bias"), F.round("rmse", 3).alias("rmse"), r6(F.col("slope_origin")).alias("slope_origin"), F.round("nse", 5).alias("nse"), r6(F.col("amplitude_ratio")).alias("amplitude_ratio"))


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS t, sum(o_totalprice) AS x FROM orders GROUP BY 1), z AS (SELECT t, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS z FROM o), k AS (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS lag)
SELECT lag, round(avg(a.z * b.z), 6) AS rho, count(*) AS n FROM k CROSS JOIN z a JOIN z b ON b.t = a.t + lag GROUP BY 1""")
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("t")).agg(F.sum("o_totalprice").alias("x"))
    return rounded(stats.autocorrelation(o, [], "t", "x", 14))


@query(f"""{_MONTHLY}, b AS (SELECT q, x, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM mo), k AS (SELECT unnest(range(0, (SELECT count(*) FROM mo))) AS k),
r AS (SELECT k, any_value(a.n) AS n, corr(a.q, c.x) AS r FROM k CROSS JOIN b a JOIN b c ON c.i = (a.i + k) % a.n GROUP BY 1), o AS (SELECT abs(r) AS own FROM r WHERE k = 0)
SELECT any_value(n) AS n, round(max(r) FILTER (k = 0), 6) AS r, count(*) FILTER (k > 0) AS shifts, round((count(*) FILTER (k > 0 AND abs(r) >= own - 1e-12) + 1) / (count(*) FILTER (k > 0) + 1), 6) AS p FROM r, o WHERE k = 0 OR (k >= 3 AND k <= n - 3)""")
def circular_shift(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.shift_null(monthly(spark, d), [], "m", "q", "x"))


_DRAWS = f"""{_MONTHLY}, b AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k, count(*) OVER () AS n FROM mo), dr AS (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS draw),
p AS (SELECT draw, CAST('0x' || substr(md5('7-' || draw || '-' || k), 1, 8) AS BIGINT) % n AS pick FROM dr CROSS JOIN b), w AS (SELECT draw, b.m, count(*) AS w FROM p JOIN b ON b.k = p.pick GROUP BY ALL)"""


@query(f"{_DRAWS} SELECT draw, m, w FROM w")
def block_weights(spark: SparkSession, d: str) -> DataFrame:
    return resample.block_weights(monthly(spark, d), "m", 200, 7)


@query(f"""{_DRAWS}, s AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT draw, sum(w * s) / sum(w * n) AS mean FROM w JOIN s USING (m) GROUP BY 1)
SELECT round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high, count(*) AS n FROM e""")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).withColumn("m", F.trunc("l_shipdate", "month"))
    return rounded(resample.interval(resample.bootstrap_mean(li, "m", "l_extendedprice", 200, 7), "mean"), 4)


@query("""WITH p AS (SELECT CAST(o_orderdate AS DATE) AS t1, CAST(l_shipdate AS DATE) AS t2, l_quantity AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey), x AS (SELECT t1 AS date, v FROM p UNION ALL SELECT t2, v FROM p WHERE t1 <> t2), o AS (SELECT date, sum(v) AS s, count(*) AS n FROM x GROUP BY 1), t AS (SELECT sum(v) AS s, count(*) AS n FROM p)
SELECT date, round((t.s - o.s) / (t.n - o.n), 6) AS mean_without FROM o, t""")
def date_jackknife(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").join(lineitem(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_date("o_orderdate").alias("t1"), F.to_date("l_shipdate").alias("t2"), F.col("l_quantity").alias("v"))
    return rounded(resample.date_jackknife(p, "t1", "t2", "v"))


@query("SELECT event_type, round((1 + count(*) FILTER (value >= 90)) / (1 + count(value)), 6) AS p, count(value) AS n FROM events GROUP BY 1")
def empirical_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.empirical_p(table(spark, d, "events").withColumn("observed", F.lit(90.0)), ["event_type"], "value", "observed"))


@query()
def exact_spearman(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    return rounded(resample.spearman_exact(y, "v", "n"))


@query()
def greedy_matches(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    return rounded(resample.nearest_matches(s.where(odd), s.where(~odd), "s_suppkey", "s_acctbal", 100.0, "s_nationkey", "s_nationkey"))


_PHASE = "2 * pi() * (l_extendedprice / 1000 - floor(l_extendedprice / 1000))"


def phases(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice") / 1000
    return lineitem(spark, d).withColumn("phase", TURN * (x - F.floor(x)))


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, sum(l_discount * sin({_PHASE})) AS s, sum(l_discount * cos({_PHASE})) AS c, sum(l_discount) AS w, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(atan2(s, c), 5) AS phase, round(sqrt(s * s + c * c) / w, 6) AS r, n FROM g""")
def phasor_zones(spark: SparkSession, d: str) -> DataFrame:
    return rounded(circular.phasor_mean(phases(spark, d), ["l_returnflag", "l_linestatus"], F.col("phase"), F.col("l_discount")).withColumn("phase", F.round("phase", 5)))


@query(f"""WITH g AS (SELECT l_linenumber AS pair, l_returnflag, atan2(sum(sin({_PHASE})), sum(cos({_PHASE}))) AS p FROM lineitem GROUP BY ALL)
SELECT a.pair, round(atan2(sin(a.p - c.p), cos(a.p - c.p)), 5) AS dd FROM g a JOIN g c ON a.pair = c.pair AND a.l_returnflag = 'A' AND c.l_returnflag = 'R'""")
def double_difference(spark: SparkSession, d: str) -> DataFrame:
    z = circular.phasor_mean(phases(spark, d), ["l_linenumber", "l_returnflag"], F.col("phase"), F.lit(1.0)).withColumnRenamed("l_linenumber", "pair")
    return rounded(circular.double_difference(z, "pair", "l_returnflag", "phase", "A", "R"), 5)


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice - 27.7328815 * round_even(l_extendedprice / 27.7328815, 0), 5) AS wrapped, round(round_even((l_tax * 1000 - l_discount * 1000) / 27.7328815, 0), 0) AS cycles FROM lineitem""")
def cycle_choice(spark: SparkSession, d: str) -> DataFrame:
    c = scalar.WAVELENGTH_MM / 2
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", F.round(circular.wrap_to(F.col("l_extendedprice"), c), 5).alias("wrapped"), circular.cycles(F.col("l_tax") * 1000 - F.col("l_discount") * 1000, c).alias("cycles"))


# relational basics


@query("SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS f_qty, sum(l_quantity) FILTER (l_linestatus = 'O') AS o_qty FROM lineitem GROUP BY 1")
def pivot_status(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem(spark, d).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.col("F").alias("f_qty"), F.col("O").alias("o_qty"))


@query("SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (1, 2)")
def season_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("season", scalar.season(F.col("o_orderdate")))
    return rounded(o.rollup("season", "o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)


@query("SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")


@query("SELECT n_name, r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderdate >= DATE '1997-01-01' GROUP BY ALL")
def nation_totals(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    j = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rounded(j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus")
    c = table(spark, d, "customer").join(o.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    f = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct()
    return c.join(f, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("has_f"))


@query("(SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R') EXCEPT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 50")
def date_sets(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    day = F.to_date("l_shipdate").alias("day")
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).intersect(li.where("l_returnflag = 'R'").select(day)).subtract(li.where("l_quantity = 50").select(day))


@query("SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS bin, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1")
def quantity_bins(spark: SparkSession, d: str) -> DataFrame:
    b = F.when(F.col("l_quantity") <= 10, 0).when(F.col("l_quantity") <= 25, 1).otherwise(2)
    return rounded(lineitem(spark, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.percentile("l_extendedprice", 0.1).alias("p10"), F.percentile("l_extendedprice", 0.9).alias("p90")), 4)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# contracts


@query("""WITH x AS (SELECT count(*) - count(DISTINCT (station, plot, date)) AS extra, count(*) FILTER (surface_cm < -100 OR (surface_cm > 100 AND NOT isnan(surface_cm))) AS s, count(*) FILTER (n_ok_hours < 0 OR n_ok_hours > 24) AS h FROM laser_daily)
SELECT * FROM (SELECT 'repeated key' AS problem, 'station,plot,date' AS column, extra AS n FROM x UNION ALL SELECT 'out of range', 'surface_cm', s FROM x UNION ALL SELECT 'out of range', 'n_ok_hours', h FROM x) WHERE n > 0""")
def contract_problems(spark: SparkSession, d: str) -> DataFrame:
    c = contracts.Contract(["station", "plot", "date"], ["surface_cm", "n_ok_hours"], {"surface_cm": (-100, 100), "n_ok_hours": (0, 24)})
    return contracts.violations(table(spark, d, "laser_daily"), c)


@query("SELECT station, count(*) AS n, round(count(CASE WHEN NOT isnan(vv_db_3x3) THEN 1 END) / count(*), 6) AS vv_db_3x3_share, round(count(CASE WHEN NOT isnan(wtd_at) THEN 1 END) / count(*), 6) AS wtd_at_share FROM plots_acq GROUP BY 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contracts.coverage(table(spark, d, "plots_acq"), ["station"], ["vv_db_3x3", "wtd_at"]))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS o_orderdate FROM orders WHERE o_orderstatus <> 'F'),
j AS (SELECT o.o_orderkey AS a, n.o_orderkey AS b, o.o_totalprice AS x, n.o_totalprice AS y, o.o_orderdate AS s, n.o_orderdate AS t FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT 'o_totalprice' AS column, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND abs(x - y) > 1e-9) AS n FROM j UNION ALL SELECT 'o_orderdate', count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND s IS DISTINCT FROM t) FROM j
UNION ALL SELECT 'only in old', count(*) FILTER (b IS NULL) FROM j UNION ALL SELECT 'only in new', count(*) FILTER (a IS NULL) FROM j""")
def table_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    changed = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = o.where("o_orderstatus <> 'F'").select("o_orderkey", changed.alias("o_totalprice"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("o_orderdate"))
    return contracts.table_diff(o.where("o_orderstatus <> 'P'"), new, ["o_orderkey"], ["o_totalprice", "o_orderdate"])


@query("""WITH k AS (SELECT date AS k, 's' AS s FROM s1_acquisitions UNION SELECT date, 'p' FROM plots_acq UNION SELECT date, 'l' FROM laser_daily) SELECT k AS date, CAST(max(CASE WHEN s = 's' THEN 1 ELSE 0 END) AS INTEGER) AS in_s1, CAST(max(CASE WHEN s = 'p' THEN 1 ELSE 0 END) AS INTEGER) AS in_plots, CAST(max(CASE WHEN s = 'l' THEN 1 ELSE 0 END) AS INTEGER) AS in_laser FROM k WHERE k IS NOT NULL GROUP BY 1""")
def date_presence(spark: SparkSession, d: str) -> DataFrame:
    sets = {"s1": "s1_acquisitions", "plots": "plots_acq", "laser": "laser_daily"}
    return contracts.presence({k: table(spark, d, t).where("date IS NOT NULL") for k, t in sets.items()}, "date")


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'signup', 'error', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def has_all_types(spark: SparkSession, d: str) -> DataFrame:
    return contracts.has_all(table(spark, d, "events"), "user_id", "event_type", ["click", "purchase", "signup", "error", "view"])


@query("SELECT acq_id FROM s1_acquisitions a WHERE NOT EXISTS (SELECT 1 FROM plots_acq p WHERE p.plot_acq_id = a.acq_id)")
def new_items(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "plots_acq").select(F.col("plot_acq_id").alias("acq_id"))
    return contracts.not_yet(table(spark, d, "s1_acquisitions"), seen, "acq_id").select("acq_id")


@query("SELECT station, plot, track, date, acq_id FROM s1_acquisitions QUALIFY row_number() OVER (PARTITION BY station, plot, track, date ORDER BY coalesce(platform, '?') DESC, acq_id) = 1")
def first_listing(spark: SparkSession, d: str) -> DataFrame:
    return contracts.first_by(table(spark, d, "s1_acquisitions"), ["station", "plot", "track", "date"], [F.desc(F.coalesce("platform", F.lit("?"))), "acq_id"]).select("station", "plot", "track", "date", "acq_id")


# scalar functions


@query("""SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'C' WHEN o_orderdate >= TIMESTAMP '1997-01-01' THEN 'B' ELSE 'A' END AS datum, CAST(CASE WHEN year(o_orderdate) = year(o_orderdate + INTERVAL 90 DAY) THEN year(o_orderdate) ELSE -1 END AS INTEGER) AS fold,
round(epoch_us(o_orderdate - TIMESTAMP '1995-01-01' + TIMESTAMP '1970-01-01') / 31557600000000.0, 6) AS years FROM orders""")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", scalar.season(t).alias("season"), scalar.datum(t, ["1999-01-01", "1997-01-01"]).alias("datum"), scalar.year_fold(t, F.date_add(t, 90)).alias("fold"), r6(scalar.years_since(t, F.lit("1995-01-01").cast("timestamp"))).alias("years"))


@query("""SELECT plot_acq_id, round(vv_db_3x3 * 55.465763 / (4 * pi()), 6) AS los_mm, round(vv_db_3x3 / cos(radians(38.5)), 6) AS vertical, abs(vv_db_3x3) > 55.465763 / 4 AS risk,
round(4 * 10 ** (vh_db_3x3 / 10) / (10 ** (vv_db_3x3 / 10) + 10 ** (vh_db_3x3 / 10)), 6) AS rvi FROM plots_acq WHERE NOT isnan(vv_db_3x3) AND NOT isnan(vh_db_3x3)""")
def radar_scalars(spark: SparkSession, d: str) -> DataFrame:
    v, h = F.col("vv_db_3x3"), F.col("vh_db_3x3")
    p = table(spark, d, "plots_acq").where(v.isNotNull() & h.isNotNull())
    return rounded(p.select("plot_acq_id", scalar.rad_to_los_mm(v).alias("los_mm"), scalar.los_to_vertical(v, F.lit(38.5)).alias("vertical"), scalar.cycle_risk(v).alias("risk"), scalar.rvi(scalar.db_to_power(v), scalar.db_to_power(h)).alias("rvi")))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber IN (4, 5, 6, 7) AND l_tax > 0 AND l_discount > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END, 6) AS ndvi, (CAST(l_quantity AS INTEGER) & 63) = 0 AS clear FROM lineitem""")
def optical_scalars(spark: SparkSession, d: str) -> DataFrame:
    b = {k: F.col("l_tax") for k in ("B03", "B04", "B05", "B11")} | {k: F.col("l_discount") for k in ("B08", "B8A")}
    i = scalar.optical_indices(b, F.col("l_linenumber"))
    return rounded(lineitem(spark, d).select("l_orderkey", "l_linenumber", i["ndvi"].alias("ndvi"), scalar.qa_clear(F.col("l_quantity").cast("int")).alias("clear")))


@query("""SELECT event_id, CAST(coalesce(round_even((least(greatest(value, 0), 80) - 0) / (80.0 / 65534), 0) - 32767, -32768) AS INTEGER) AS q, round((coalesce(round_even((least(greatest(value, 0), 80) - 0) / (80.0 / 65534), 0) - 32767, -32768) + 32767) * (80.0 / 65534), 5) AS back FROM events""")
def quantized(spark: SparkSession, d: str) -> DataFrame:
    q = scalar.quantized(F.col("value"), 0.0, 80.0)
    return rounded(table(spark, d, "events").select("event_id", q.alias("q"), scalar.dequantized(q, 0.0, 80.0).alias("back")), 5)


# kernels


@query("""WITH v AS (SELECT event_type, value, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 <> 0) AS b FROM events GROUP BY ALL), c AS (SELECT event_type, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY event_type) - sum(b) OVER w / sum(b) OVER (PARTITION BY event_type)) AS dd, a, b FROM v WINDOW w AS (PARTITION BY event_type ORDER BY value))
SELECT event_type, round(max(dd), 6) AS ks, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2 FROM c GROUP BY 1""")
def ks_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.ks_statistic(table(spark, d, "events"), ["event_type"], "value", F.col("user_id") % 2 == 0))


@query("""SELECT l_returnflag, round(sqrt(sum(l_tax * l_quantity + l_discount * l_linenumber) ** 2 + sum(l_discount * l_quantity - l_tax * l_linenumber) ** 2) / sqrt(sum(l_tax ** 2 + l_discount ** 2) * sum(l_quantity ** 2 + l_linenumber ** 2)), 6) AS coherence,
round(atan2(sum(l_discount * l_quantity - l_tax * l_linenumber), sum(l_tax * l_quantity + l_discount * l_linenumber)), 5) AS phase, count(*) AS n FROM lineitem GROUP BY 1""")
def image_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.coherence(lineitem(spark, d), ["l_returnflag"], "l_tax", "l_discount", "l_quantity", "l_linenumber").withColumn("phase", F.round("phase", 5)))


@query()
def dissimilarity_index(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(kernels.dissimilarity(e, "vec_id", "embedding", e.where("label = 0")))


@query()
def bayes_lines(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d).withColumn("one", F.lit(1.0))
    return kernels.bayes_line(li, ["l_returnflag"], ["one", "l_quantity"], "l_extendedprice", 1e6).select("l_returnflag", "n", F.transform("b", lambda x: F.round(x, 2)).alias("b"))
