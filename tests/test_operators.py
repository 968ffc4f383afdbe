"""Known answers: planted in small data and recovered."""

from __future__ import annotations

import math
import random
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quagmark.functions import scalar
from quagmark.operators import catalog, circular, contracts, hydro, islands, kernels, pairs, resample, scoring, spatial, stats, temporal
from quagmark.session import checkpointed

T0 = datetime(2022, 6, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def hourly(spark, values, t0=T0):
    return frame(spark, [("a", t0 + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)], "k string, ts timestamp, v double")


# time


def test_asof_directions_tolerance_and_lag(spark):
    source = frame(spark, [("a", datetime(2022, 1, d), float(v)) for d, v in ((1, 1), (5, 2), (20, 3))] + [(None, datetime(2022, 1, 4), 9.0)], "k string, ts timestamp, v double")
    q = frame(spark, [("a", datetime(2022, 1, 4)), ("a", datetime(2022, 1, 12)), ("b", datetime(2022, 1, 4)), ("a", None), ("a", datetime(2022, 1, 3))], "k string, ts timestamp")
    three = 3 * 86400
    near = [(r.k, r.ts, r.v, r.lag_h) for r in temporal.asof(q, source, ["k"], "ts", ["v"], three).collect()]
    got = {(k, t): (v, lag) for k, t, v, lag in near}
    assert len(near) == 5 and got[("a", datetime(2022, 1, 4))] == (2.0, 24.0) and got[("a", datetime(2022, 1, 12))] == (None, None)
    assert got[("a", datetime(2022, 1, 3))] == (1.0, -48.0)  # on equal distance the earlier row
    back = {r.ts: (r.v, r.lag_h) for r in temporal.asof(q.where("k = 'a' AND ts IS NOT NULL"), source, ["k"], "ts", ["v"], None, "backward").collect()}
    assert back[datetime(2022, 1, 4)] == (1.0, -72.0) and back[datetime(2022, 1, 12)] == (2.0, -168.0)
    assert temporal.asof(q.limit(0), source, ["k"], "ts", ["v"], three).count() == 0
    assert all(r.v is None for r in temporal.asof(q, source.limit(0), ["k"], "ts", ["v"], three).collect())


def test_asof_repeated_source_times(spark):
    source = frame(spark, [("a", T0, 1.0, 1), ("a", T0, 2.0, 2)], "k string, ts timestamp, v double, o int")
    q = frame(spark, [("a", T0)], "k string, ts timestamp")
    assert temporal.asof(q, source, ["k"], "ts", ["v"], 3600, "backward", "o").first().v == 2.0
    assert temporal.asof(q, source, ["k"], "ts", ["v"], 3600, "forward", "o").first().v == 1.0


def test_interpolation(spark):
    s = hourly(spark, [0, 10, None, None, None, 40])
    q = frame(spark, [("a", T0 + timedelta(minutes=m)) for m in (30, 60, 90, -5, 400)], "k string, ts timestamp")
    got = [r.x for r in temporal.value_at(q, s, ["k"], "ts", "v", 7200, "x").orderBy("ts").collect()]
    assert got == [None, 5.0, 10.0, None, None]
    assert temporal.value_at(q, s, ["k"], "ts", "v", None, "x").orderBy("ts").collect()[3].x == 10 + 30 * 0.5 / 4


def test_antecedent_windows(spark):
    w = {r.v: r for r in temporal.window_features(hourly(spark, range(400)), ["k"], "ts", "v", [24, 168]).collect()}
    assert w[300.0].v_mean24h == np.mean(range(277, 301)) and w[300.0].v_mean168h == np.mean(range(133, 301))
    assert w[10.0].v_mean24h is None and w[17.0].v_mean24h is not None and w[100.0].v_mean168h is None


def test_hours_since(spark):
    s = hourly(spark, [0, 1, 0, 0, 0])
    got = [r.h for r in s.select("ts", temporal.hours_since(s, ["k"], "ts", F.col("v") == 1).alias("h")).orderBy("ts").collect()]
    assert got == [None, 0.0, 1.0, 2.0, 3.0]


def test_running_median(spark):
    s = hourly(spark, [math.sin(i / 5) + (30 if i == 60 else 0) for i in range(120)]).withColumn("id", F.monotonically_increasing_id())
    out = temporal.running_median_outliers(s, ["k"], "ts", "id", "v").where("outlier").collect()
    assert [r.ts for r in out] == [T0 + timedelta(hours=60)]


# runs


def test_chain_breaks_at_gaps_and_nulls(spark):
    d = [T0 + timedelta(days=6 * i) for i in range(8)]
    rows = [("a", d[i], d[i + 1], x) for i, x in ((0, 1.0), (1, 2.0), (3, 4.0), (4, None), (5, 5.0), (6, 1.0))]
    c = islands.chain(frame(spark, rows, "k string, t1 timestamp, t2 timestamp, est double"), ["k"], "t1", "t2", "est").orderBy("seg", "time").collect()
    assert [(r.seg, r.time, r.est) for r in c] == [(0, d[0], 0), (0, d[1], 1), (0, d[2], 3), (1, d[3], 0), (1, d[4], 4), (2, d[5], 0), (2, d[6], 5), (2, d[7], 6)]


def test_centred_runs(spark):
    inc = [1.0, 1.0, 1.0, 1.0, None, 2.0, 2.0, 2.0]
    rows = frame(spark, [("a", i, x) for i, x in enumerate(inc)], "k string, i int, inc double")
    got = [(r.i, r.level) for r in islands.centred_runs(rows, ["k"], "i", "inc").orderBy("i").collect()]
    assert got == [(0, -1.5), (1, -0.5), (2, 0.5), (3, 1.5)]


def test_longest_run_prefers_the_earliest(spark):
    s = hourly(spark, [1, 1, 0, 1, 1, 0, 1])
    r = islands.longest_run(islands.runs_of(s, ["k"], "ts", F.col("v") == 1), ["k"]).first()
    assert (r["first"], r.n) == (T0, 2)


# angles and pairs


def test_phasor_near_the_cut_and_empty_weights(spark):
    df = frame(spark, [("a", math.pi - 0.1, 1.0), ("a", -math.pi + 0.1, 1.0), ("b", 1.0, 0.0)], "k string, p double, w double")
    got = {r.k: r for r in circular.phasor_mean(df, ["k"], F.col("p"), F.col("w")).collect()}
    assert abs(abs(got["a"].phase) - math.pi) < 1e-12 and abs(got["a"].r - math.cos(0.1)) < 1e-12 and got["b"].phase is None


def test_closure_of_true_motion_is_zero(spark):
    level, d = [0.0, 1.3, -2.0, 4.0], [date(2022, 1, 1) + timedelta(days=6 * i) for i in range(4)]
    p = frame(spark, [("x", d[i], d[j], math.remainder(level[j] - level[i], 2 * math.pi)) for i in range(4) for j in range(i + 1, 4)], "k string, t1 date, t2 date, ph double")
    t = circular.triangles(p, ["k"], "t1", "t2", "ph", 24).collect()
    assert len(t) == 4 and max(abs(r.closure) for r in t) < 1e-12


def test_pairs_within_lag_and_bars(spark):
    rows = frame(spark, [("a", date(2022, 1, 1) + timedelta(days=12 * i), float(i)) for i in range(5)], "k string, d date, v double")
    c = pairs.pair_changes(rows, ["k"], "d", "v", 24, lambda a, b: (a <= F.lit(date(2022, 1, 25))) & (b > F.lit(date(2022, 1, 25)))).collect()
    assert sorted(r.lag for r in c) == [12, 12, 12, 24]


def test_wilson(spark):
    low, high = pairs.wilson(F.col("k"), F.col("n"))
    got = [(r.low, r.high) for r in frame(spark, [(0, 10), (5, 10), (0, 0)], "k int, n int").select(low.alias("low"), high.alias("high")).collect()]
    assert abs(got[0][1] - 0.2775) < 1e-4 and abs(got[1][0] - 0.2366) < 1e-4 and abs(got[1][1] - 0.7634) < 1e-4 and got[2] == (None, None)


def test_exceedance_of_a_sinusoid(spark):
    amp, thr = 30, 13.9
    s = frame(spark, [("a", date(2000, 1, 1) + timedelta(days=i), amp * math.sin(2 * math.pi * i / 365)) for i in range(1460)], "k string, d date, v double")
    e = pairs.exceedance(pairs.pair_changes(s, ["k"], "d", "v", 100), thr, [30, 31, 100, 101]).collect()
    for r in e:
        if r.lag_from in (30, 100):
            env = 2 * amp * abs(math.sin(math.pi * r.lag_from / 365))
            assert abs(r.share - 2 / math.pi * math.acos(min(1, thr / env))) < 0.02


def test_components_of_a_random_graph(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in pairs.components(frame(spark, edges, "a int, b int"), "a", "b", checkpointed).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: root(x) for x in parent if x != 3 or 3 in got}


# statistics


def test_fit_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    t, y = rng.uniform(0, 5, 300), rng.normal(size=300)
    rows = [("a", float(a), float(3 + 2 * a + 5 * math.cos(2 * math.pi * a - 1) + b)) for a, b in zip(t, y, strict=True)] + [("b", 1.0, 1.0), ("a", None, 2.0)]
    df = frame(spark, rows, "k string, t double, y double")
    x = np.column_stack([np.ones(300), t, np.cos(2 * np.pi * t), np.sin(2 * np.pi * t)])
    want = np.linalg.lstsq(x, np.array([r[2] for r in rows[:300]]), rcond=None)[0]
    got = {r.k: r for r in stats.fit(df, ["k"], stats.annual_columns(F.col("t")), F.col("y"), 6).collect()}
    assert np.allclose(got["a"].b, want, atol=1e-9) and got["b"].b is None
    h = stats.harmonic(df.where("k = 'a'"), ["k"], F.col("t"), F.col("y")).first()
    assert abs(h.amplitude - math.hypot(want[2], want[3])) < 1e-9 and abs(h.phase_doy - 365.25 / (2 * math.pi)) < 5


def test_false_discovery_rates(spark):
    df = frame(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2), (5, None)], "i int, p double")
    got = {r.i: r.q for r in stats.bh_qvalues(df, [], "p").collect()}
    assert [None if got[i] is None else round(got[i], 5) for i in range(1, 6)] == [0.04, 0.05333, 0.05333, 0.2, None]


def test_weighted_median_equals_repetition(spark):
    rows = [(1.0, 1), (2.0, 3), (5.0, 2), (9.0, 2), (100.0, 0)]
    got = stats.weighted_median(frame(spark, rows, "x double, w int"), [], "x", "w").first()[0]
    assert got == np.median(np.repeat([r[0] for r in rows], [r[1] for r in rows]))


def test_no_spread_gives_no_correlation(spark):
    df = frame(spark, [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "t double, e double")
    r = stats.agreement(df, [], "t", "e").first()
    assert r.r is None and r.n == 3 and r.nse is None
    assert stats.lines(df, [], "t", "e").first().slope is None


def test_ranks_and_tests(spark):
    df = frame(spark, [(1.0, True), (2.0, True), (2.0, False), (3.0, False), (4.0, False)], "v double, f boolean")
    r = stats.mann_whitney(df, [], "v", F.col("f")).first()
    assert r.u == 0.5 and 0 < r.p <= 1
    z = frame(spark, [(0.0,), (1.96,), (-1.96,)], "z double").select(stats.normal_cdf(F.col("z")).alias("c")).collect()
    assert [round(x.c, 4) for x in z] == [0.5, 0.975, 0.025]


def test_circular_shift_of_a_copy_and_of_noise(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    df = frame(spark, [("same", i, float(v), float(v)) for i, v in enumerate(x)] + [("noise", i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, rng.normal(size=60), strict=True))], "k string, i int, x double, y double")
    got = {r.k: r for r in resample.shift_null(df, ["k"], "i", "x", "y").collect()}
    assert abs(got["same"].r - 1) < 1e-9 and got["same"].p == 1 / (got["same"].shifts + 1) and got["noise"].p > 0.02


def test_block_weights_add_up(spark):
    w = resample.block_weights(frame(spark, [(3,), (1,), (7,)], "b int"), "b", 50).groupBy("draw").agg(F.sum("w").alias("s")).collect()
    assert len(w) == 50 and {r.s for r in w} == {3}


def test_greedy_matching(spark):
    t = frame(spark, [("t0", 10.0), ("t1", 12.0), ("t2", 50.0)], "id string, x double")
    c = frame(spark, [("c0", 13.0), ("c1", 9.0), ("c2", 90.0)], "id string, x double")
    m = lambda cal: {(r.treated, r.control) for r in resample.nearest_matches(t, c, "id", "x", cal).collect()}
    assert m(40) == {("t0", "c1"), ("t1", "c0"), ("t2", "c2")} and m(39) == {("t0", "c1"), ("t1", "c0")}


def test_exact_spearman(spark):
    r = resample.spearman_exact(frame(spark, [(float(i), float(i)) for i in range(5)], "x double, y double"), "x", "y").first()
    assert abs(r.rho - 1) < 1e-9 and abs(r.p - 2 / 120) < 1e-9


# kernels


def net(level, d, keep=lambda i, j: True):
    return [("px", d[i], d[j], level[j] - level[i], 1.0) for i in range(len(d)) for j in range(i + 1, min(i + 4, len(d))) if keep(i, j)]


def test_inversion_recovers_a_trend_and_marks_uncovered(spark):
    d = [12 * i for i in range(20)]
    level = [-30 / 365 * x for x in d]
    out = kernels.invert_network(frame(spark, net(level, d), "px string, i int, j int, y double, w double"), ["px"], "i", "j", "y", "w").orderBy("t").collect()
    assert np.allclose([r.level for r in out], level)
    cut = kernels.invert_network(frame(spark, net(level, d, lambda i, j: not i <= 9 < j), "px string, i int, j int, y double, w double"), ["px"], "i", "j", "y", "w").orderBy("t").collect()
    assert [r.t for r in cut if not r.covered] == [120]


def test_phase_linking(spark):
    d = list(range(0, 120, 12))
    ph = [0.4 * i * i / 9 for i in range(10)]
    rows = [("px", d[i], d[j], math.remainder(ph[j] - ph[i], 2 * math.pi), 0.8) for i in range(10) for j in range(i + 1, min(10, i + 4))]
    out = kernels.link_phases(frame(spark, rows, "px string, i int, j int, p double, c double"), ["px"], "i", "j", "p", "c").orderBy("t").collect()
    assert max(abs(math.remainder(r.phase - p, 2 * math.pi)) for r, p in zip(out, ph, strict=True)) < 1e-6 and out[0].tcoh > 0.999


def test_smoother_resolves_a_cycle(spark):
    rng = np.random.default_rng(3)
    d = [6 * i for i in range(60)]
    x = [0.0]
    for _ in d[1:]:
        r = math.exp(-6 / 25)
        x.append(r * x[-1] + 6 * math.sqrt(1 - r * r) * rng.normal())
    rows = [("px", d[i], d[i + 1], x[i + 1] - x[i] + 0.5 * rng.normal() + (60.0 if i == 30 else 0), 0.5) for i in range(59)]
    df = frame(spark, rows, "px string, i int, j int, y double, sd double")
    out = kernels.ou_smooth(df, ["px"], "i", "j", "y", "sd", 25.0, 6.0, cycle=60.0).orderBy("t").collect()
    err = np.array([r.mean for r in out]) - np.array(x)
    assert np.sqrt(np.mean((err - err.mean()) ** 2)) < 3 and all(r.sd > 0 for r in out)


def test_phase_correlation(spark):
    a = np.random.default_rng(0).normal(size=(16, 16))
    b = np.roll(a, (3, -2), (0, 1))
    r = kernels.phase_shift(frame(spark, [("x", a.ravel().tolist(), b.ravel().tolist())], "k string, a array<double>, b array<double>"), ["k"], "a", "b", 16).first()
    assert (r.dr, r.dc) == (3, -2)


# scoring


def scored(spark, factor):
    d = [datetime(2021, 4, 1) + timedelta(days=6 * i) for i in range(100)]
    level = [30 * math.sin(2 * math.pi * (x - d[0]).days / 365) for x in d]
    rows = [("a", d[i], d[i + 1], level[i + 1] - level[i], factor * (level[i + 1] - level[i])) for i in range(99) if i != 20]
    p = frame(spark, rows, "k string, t1 timestamp, t2 timestamp, truth_inc_mm double, est_mm double")
    truth = frame(spark, [("a", t, v) for t, v in zip(d, level, strict=True)], "k string, time timestamp, level double")
    return p, truth


def test_scores_of_a_perfect_and_a_halved_series(spark):
    for factor in (1.0, 0.5):
        p, truth = scored(spark, factor)
        s = scoring.score(p, truth, ["k"], scoring.Protocol())
        inc = s["increments"].first()
        assert abs(inc.slope_origin - factor) < 1e-9 and abs(inc.r - 1) < 1e-9 and inc.within == 1
        span = s["levels"].where("view = 'span'").first()
        assert abs(span.r - 1) < 0.05 or factor == 1.0
        assert s["years"].count() == 2 and s["seasons"].count() == 4 and s["winters"].count() == 1


def test_locked_years(spark):
    p, truth = scored(spark, 1.0)
    with pytest.raises(scoring.LockedError):
        scoring.score(p, truth, ["k"], scoring.Protocol(locked_years=(2022,)))
    scoring.score(p, truth, ["k"], scoring.Protocol(locked_years=(2022,)), leave=True)


def test_relevel(spark):
    lv = frame(spark, [("a", T0 + timedelta(days=i), 0, float(i)) for i in range(4)], "k string, time timestamp, seg int, est double")
    st = frame(spark, [("a", T0 + timedelta(days=2), -7.0)], "k string, t timestamp, d double")
    assert [r.est for r in scoring.relevel(lv, ["k"], st, "t", "d").orderBy("time").collect()] == [0.0, 1.0, -5.0, -4.0]


# water


def test_recursions(spark):
    rows = frame(spark, [("a", i, p) for i, p in enumerate([5.0, 1.0, None, 2.0])], "k string, d int, p double")
    api = [round(r.api, 9) for r in hydro.antecedent_precipitation(rows, ["k"], "d", "p").orderBy("d").collect()]
    assert api == [0.0, 1.0, 0.9, 2.81]
    b = [round(r.level, 9) for r in hydro.bucket(rows.withColumn("e", F.lit(1.0)), ["k"], "d", "p", "e", 0.0, 1.0, 1.0, 0.0, 0.0).orderBy("d").collect()]
    assert b == [4.0, 4.0, 3.0, 4.0]


def test_textbook_weather(spark):
    r = frame(spark, [(1,)], "i int").select(hydro.extraterrestrial_radiation(F.lit(246), F.lit(-20.0)).alias("ra"), hydro.dew_point_c(F.lit(20.0), F.lit(100.0)).alias("td"), hydro.rain_class(F.lit(74.9)).alias("c")).first()
    assert abs(r.ra - 32.2) < 0.1 and abs(r.td - 20) < 1e-9 and r.c == "very dry"


# grids, contracts, catalogue, scalars


def test_polygon_and_relocation(spark):
    g = frame(spark, [(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, v double")
    inside = g.where(spatial.in_polygon(F.col("col"), F.col("row"), [(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)])).count()
    assert inside == 4
    moved = {(r.row, r.col): r.value for r in spatial.relocated(g, [], "row", "col", "v", 1, 0).collect()}
    assert moved[(0, 0)] == 10.0 and moved[(3, 0)] is None


def test_contract(spark):
    df = frame(spark, [("2024-01-01", 200.0, 3), ("2024-01-01", float("nan"), 30)], "date string, surface_cm double, n_ok_hours int")
    got = {(r.problem, r.column, r.n) for r in contracts.violations(df, contracts.GOLD["truth_laser_daily"]).collect()}
    assert got == {("repeated key", "date", 1), ("out of range", "surface_cm", 1), ("out of range", "n_ok_hours", 1)}
    assert [r.column for r in contracts.violations(df.drop("n_ok_hours"), contracts.GOLD["truth_laser_daily"]).collect()] == ["n_ok_hours"]
    assert contracts.violations(df.limit(0), contracts.GOLD["truth_laser_daily"]).count() == 0


def test_catalogue(spark):
    e = [catalog.Entry("a", "experiment", code="a.py", outputs=["x/t.csv"], tickets=["T1"]), catalog.Entry("b", "phase", code="b.py", inputs=["y/t.csv"], extra={"chain": "c1"}), catalog.Entry("c", "other"), catalog.Entry("a", "experiment", code="z.py")]
    reg = catalog.register(spark, e)
    assert {(r.id, r.problem) for r in catalog.problems(reg).collect()} == {("a", "repeated id"), ("c", "unknown kind"), ("c", "no code")}
    assert [r.id for r in catalog.find(reg, chain="c1").collect()] == ["b"] and catalog.find(reg, ticket="T1").count() == 1
    r = catalog.lineage(reg).first()
    assert (r.item, r.producers, r.consumers) == ("t.csv", ["a"], ["b"])


def test_scalars(spark):
    r = frame(spark, [(1,)], "i int").select(
        *(scalar.qa_clear(F.lit(q)).alias(f"q{q}") for q in (21824, 22280, 1, 30048)),
        scalar.round_to_hour(F.lit(datetime(2022, 1, 1, 0, 30)).cast("timestamp")).alias("h0"), scalar.round_to_hour(F.lit(datetime(2022, 1, 1, 1, 30)).cast("timestamp")).alias("h1"),
        scalar.stamps_of_name(F.lit("X_20240103T010203_20240101T000000_y")).alias("n"), scalar.stamps_of_name(F.lit("X_20240103T010203")).alias("n1"),
        scalar.pair_dates(F.lit("20200101_20200113"))[1].alias("d2"), scalar.overpass_utc(F.lit(date(2020, 1, 1)), F.lit("ascending")).alias("o"),
        *(x.alias(n) for n, x in zip(("e", "n2"), scalar.utm33(F.lit(16.5), F.lit(53.5)), strict=True)),
    ).first()
    assert [r.q21824, r.q22280, r.q1, r.q30048] == [True, False, False, False]
    assert r.h0 == datetime(2022, 1, 1, 0) and r.h1 == datetime(2022, 1, 1, 2) and r.n == "20240101_20240103" and r.n1 is None
    assert r.d2 == date(2020, 1, 13) and r.o == datetime(2020, 1, 1, 16, 36)
    assert abs(r.e - 599506) < 100 and abs(r.n2 - 5929000) < 2000
    assert T0.replace(tzinfo=UTC).year == 2022


def test_optical_indices(spark):
    df = frame(spark, [(0.1, 0.3, 4), (0.1, 0.3, 9), (0.0, 0.3, 4), (0.1, 0.3, 11)], "r double, n double, scl int")
    b = {k: F.col("r") for k in ("B03", "B04", "B05", "B11")} | {k: F.col("n") for k in ("B08", "B8A")}
    i = scalar.optical_indices(b, F.col("scl"))
    got = [(None if r.ndvi is None else round(r.ndvi, 9), r.snow) for r in df.select(i["ndvi"].alias("ndvi"), i["snow"].alias("snow")).collect()]
    assert got == [(0.5, False), (None, False), (None, False), (None, True)]
