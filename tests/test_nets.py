"""Joins by range, running sums in parts, rank tests, resampling and neighbours against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quagmark.operators import contracts, hydro, kernels, pairs, resample, spatial, stats, temporal
from quagmark.plans import registry
from quagmark.streaming import live


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def networks():
    rng = random.Random(12)
    return [(rng.choice("ab"), t, t + rng.choice([6, 12, 18]), rng.random() < 0.5) for t in (rng.randrange(0, 90) for _ in range(80))]


def test_both_ends(spark, networks):
    a = sorted({x[:3] for x in networks[:40]})
    b = sorted({x[:3] for x in networks[40:]})
    got = {tuple(r) for r in pairs.both_ends(frame(spark, a, "k string, t1 int, t2 int"), frame(spark, b, "k string, t1 int, t2 int"), ["k"], "t1", "t2", 1.5, 2.0).collect()}
    first = {}
    for k, a1, a2 in a:
        near = [(b1, b2) for q, b1, b2 in b if q == k and abs(b1 - a1 - 1.5) <= 2 and abs(b2 - a2 - 1.5) <= 2]
        if near:
            first.setdefault((k, *min(near)), (a1, a2))
    assert got == {(k, *x, b1, b2) for (k, b1, b2), x in first.items()} and got


def test_bridged_gaps(spark, networks):
    rows = [*networks, ("c", 5, None, True), ("d", 1, 2, None)]
    got = {(r.k, r.t1, r.t2): r.bridged for r in pairs.bridged_gaps(frame(spark, rows, "k string, t1 int, t2 int, ok boolean"), ["k"], "t1", "t2", F.col("ok")).collect()}
    want = {("d", 1, 2): False}
    for k in "ab":
        dates = sorted({t for q, t1, t2, _ in networks if q == k for t in (t1, t2)})
        want |= {(k, x, y): any(q == k and ok and t1 <= x and t2 >= y for q, t1, t2, ok in networks) for x, y in itertools.pairwise(dates)}
    assert got == want


def test_none_between(spark, networks):
    dates = [("a", 10), ("a", 40), ("a", 40), ("b", 33), ("b", None)]
    p = frame(spark, networks, "k string, t1 int, t2 int, ok boolean")
    got = sorted(tuple(r) for r in pairs.none_between(p, frame(spark, dates, "k string, d int"), ["k"], "t1", "t2", "d").collect())
    assert got == sorted(x for x in networks if not any(k == x[0] and t is not None and x[1] < t < x[2] for k, t in dates))


def test_nearest_valid_falls_through_to_the_next_scene(spark):
    scenes = [("p", 100, 1.0, 0.2), ("p", 130, 2.0, 0.9), ("p", 90, None, 1.0), ("q", 100, 5.0, None)]
    s = frame(spark, scenes, "px string, t long, v double, ok double").withColumn("t", F.col("t").cast("timestamp"))
    q = frame(spark, [("p", 101), ("q", 101), ("p", 500)], "px string, t long").withColumn("t", F.col("t").cast("timestamp"))
    out = {(r.px, r.t.timestamp()): (r.v, r.lag_h) for r in temporal.nearest_valid(q, s, ["px"], "t", "v", "ok", 60).collect()}
    assert sorted(v for v in out.values() if v[0] is not None) == [(2.0, 29 / 3600)] and len(out) == 3


def test_running_sums_and_medians_in_parts(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v), float(w)) for v, w in zip(rng.normal(size=3000).round(2), rng.integers(1, 5, 3000), strict=True)] + [("b", 7.0, 1.0)] * 400 + [("b", None, 1.0)]
    df = frame(spark, rows, "k string, v double, w double")
    a = np.array([r[1] for r in rows[:3000]])
    got = {r.k: r.median for r in stats.medians(df, ["k"], "v").collect()}
    assert got == {"a": pytest.approx(np.median(a)), "b": 7.0}
    order = np.argsort(a, kind="stable")
    w = np.array([r[2] for r in rows[:3000]])[order]
    c = np.cumsum(w)
    assert {r.k: r.weighted_median for r in stats.weighted_median(df, ["k"], "v", "w").collect()}["a"] == pytest.approx((a[order][np.searchsorted(c, c[-1] / 2)] + a[order][np.searchsorted(c, c[-1] / 2, "right")]) / 2)
    ranks = stats.ranked(df.where("k = 'a'"), ["k"], "v", "r", "t").select("v", "r", "t").distinct().collect()
    assert all(r.r == (a < r.v).sum() + ((a == r.v).sum() + 1) / 2 and r.t == (a == r.v).sum() for r in ranks)
    assert stats.ranked(df, ["k"], "v", "r").where("r IS NULL").count() == 1


def test_exact_p_of_signed_ranks(spark):
    values = [1.2, -0.4, 2.0, 3.1, -0.9, 1.7]
    got = stats.wilcoxon(frame(spark, [(v,) for v in values] + [(0.0,), (None,)], "d double"), [], "d").first()
    ranks = np.argsort(np.argsort(np.abs(values))) + 1
    own = min(ranks[np.array(values) > 0].sum(), ranks[np.array(values) < 0].sum())
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=6)]
    assert got.n == 6 and got.p == pytest.approx(min(1, 2 * np.mean([s <= own for s in sums])))
    tied = stats.wilcoxon(frame(spark, [(float(v),) for v in [1, 1, 1, -1, 2, 2, 3, -3, 4, 5]], "d double"), [], "d").first()
    n, ties = 10, (4**3 - 4) + (2**3 - 2) + (2**3 - 2)
    z = abs(tied.w_plus - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert tied.p == pytest.approx(2 * (1 - 0.5 * (1 + np.vectorize(__import__("math").erf)(z / 2**0.5))), abs=1e-6)


def test_signed_ranks_of_millions(spark):
    n = 2_000_000
    got = stats.wilcoxon(spark.range(0, n, 1, 4).select((F.when(F.col("id") % 2000 < 1001, 1.0).otherwise(-1.0) * (1 + F.col("id") % 4)).alias("d")), [], "d").first()
    k = np.arange(n)
    size = 1 + k % 4
    rank = (size - 1) * n // 4 + (n // 4 + 1) / 2
    plus = rank[k % 2000 < 1001].sum()
    z = abs(plus - n * (n + 1) / 4) / np.sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - 4 * ((n / 4) ** 3 - n / 4) / 48)
    assert (got.n, got.w_plus, got.w_minus) == (n, plus, rank.sum() - plus) and 0.01 < got.p < 0.99
    assert got.p == pytest.approx(2 * (1 - 0.5 * (1 + np.vectorize(__import__("math").erf)(z / 2**0.5))), abs=1e-6)


def test_exact_p_of_kendall(spark):
    y = [1.0, 3.0, 2.0, 5.0, 4.0, 6.0]
    got = stats.theil_sen(frame(spark, [(float(i), v) for i, v in enumerate(y)], "x double, y double"), [], "x", "y").first()
    score = lambda p: sum(np.sign(p[j] - p[i]) for i in range(len(p)) for j in range(i + 1, len(p)))
    slopes = sorted((y[j] - y[i]) / (j - i) for i in range(6) for j in range(i + 1, 6))
    assert got.tau == pytest.approx(score(y) / 15) and got.slope == pytest.approx(np.median(slopes)) and got.intercept == pytest.approx(np.median(y) - np.median(slopes) * 2.5)
    assert got.p == pytest.approx(np.mean([abs(score(p)) >= score(y) for p in itertools.permutations(y)]))
    assert got.low in [pytest.approx(s) for s in slopes] and got.low <= got.slope <= got.high
    tied = stats.theil_sen(frame(spark, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (4.0, 5.0)], "x double, y double"), [], "x", "y").first()
    assert tied.tau == pytest.approx(3 / np.sqrt(9 * 8)) and tied.pairs == 9


def test_bootstrap_draws_are_even_and_the_interval_covers(spark):
    n = 150
    blocks = frame(spark, [(k,) for k in range(n)], "b int")
    w = resample.block_weights(blocks, "b", 200, 3)
    distinct = w.groupBy("draw").agg(F.count("*").alias("d"), F.sum("w").alias("s")).agg(F.avg("d").alias("d"), F.min("s").alias("low"), F.max("s").alias("high")).first()
    assert abs(distinct.d / n - (1 - np.exp(-1))) < 0.01 and distinct.low == distinct.high == n
    each = w.groupBy("b").agg(F.sum("w").alias("s")).toPandas().s
    assert abs(each.mean() - 200) < 1e-9 and 0.8 < each.std() / np.sqrt(200) < 1.2
    rng = np.random.default_rng(5)
    inside = 0
    values = rng.normal(size=(20, 60))
    for k, own in enumerate(values):
        df = frame(spark, [(i, float(v)) for i, v in enumerate(own)], "b int, v double")
        i = resample.interval(resample.bootstrap_mean(df, "b", "v", 200, k), "mean").first()
        inside += i.low <= 0 <= i.high
        assert 0.7 < (i.high - i.low) / (2 * 1.96 * own.std() / np.sqrt(60)) < 1.3
    assert inside >= 16


def test_permutation_within_groups(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(20)]
    out = resample.permuted_within(frame(spark, rows, "id int, g string, x double"), ["g"], "id", "x", 30, 1).collect()
    assert len(out) == 600 and any(r.x != r.x_permuted for r in out)
    for d in range(30):
        for g in "ab":
            assert sorted(r.x_permuted for r in out if r.draw == d and r.g == g) == sorted(r[2] for r in rows if r[1] == g)


def test_matched_zones_have_the_sizes_and_are_compact(spark):
    cells = frame(spark, [(r, c) for r in range(12) for c in range(12)] + [(None, 1)], "row int, col int")
    out = resample.matched_zones(cells, "row", "col", 9, 16, 8, 2).toPandas()
    assert (out.groupby(["trial", "zone"]).size().unstack() == [16, 9]).all().all() and out.trial.nunique() == 8
    assert all(np.hypot(g.row - g.row.mean(), g.col - g.col.mean()).max() < 7 for _, g in out.groupby("trial"))
    assert not out.duplicated(["trial", "row", "col"]).any() and resample.matched_zones(cells, "row", "col", 100, 100, 3).count() == 0


def broadcast_rows(df):
    """Rows of every broadcast of a frame that has run."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            out.append(node.metrics().get("numOutputRows").get().value())
        inner = node.children() if not kind.endswith("QueryStageExec") else None
        todo += [inner.apply(k) for k in range(inner.size())] if inner is not None else [node.plan()]
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else []
    return out


def test_null_zones_do_not_broadcast_the_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, "n", "b", "t", int(rng.integers(1, 51)), float(rng.integers(900, 2000))) for k in range(4000)]
    frame(spark, rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = registry.queries()["null_zones"](spark, str(tmp_path))
    got = sorted(tuple(r[c] for c in ("trial", "difference", "n_target", "n_reference")) for r in df.collect())
    sent = broadcast_rows(df)
    assert sent and max(sent) <= 20 * 60
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    theirs = sorted(con.execute(f"SELECT trial, difference, n_target, n_reference FROM ({registry.oracle_sql()['null_zones']})").fetchall())
    assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in theirs] and [r[1] for r in got] == pytest.approx([r[1] for r in theirs]) and len(got) == 20


def test_matched_zones_of_scattered_cells(spark):
    rng = random.Random(9)
    cells = sorted({(rng.choice([0, 5, 70_000, 2_000_000]) + rng.randrange(9), rng.choice([0, 90_000]) + rng.randrange(6)) for _ in range(150)})
    out = resample.matched_zones(frame(spark, cells, "row int, col int"), "row", "col", 20, 30, 6, 3).collect()
    md5 = lambda *x: hashlib.md5("-".join(map(str, x)).encode()).hexdigest()
    for t in range(6):
        r0, c0 = min(cells, key=lambda x: (md5(3, t, *x), x))
        patch = sorted(cells, key=lambda x: ((x[0] - r0) ** 2 + (x[1] - c0) ** 2, x))[:50]
        angle = int(md5(3, t)[:8], 16) / 2**32 * np.pi
        along = sorted(patch, key=lambda x: (round(x[0] * np.cos(angle) + x[1] * np.sin(angle), 6), x))
        assert {(r.row, r.col): r.zone for r in out if r.trial == t} == {x: "target" if k < 20 else "reference" for k, x in enumerate(along)}


def test_two_sights_without_spread_are_the_solution(spark):
    east, up = np.array([2.0, -1.0]), np.array([5.0, 3.0])
    a, b = -0.6 * east + 0.8 * up, 0.65 * east + 0.75 * up
    row = (*map(float, (a[0], a[1])), *([0.0] * 3), *map(float, (b[0], b[1])), *([0.0] * 3))
    names = "a_cos double, a_sin double, a_cc double, a_ss double, a_cs double, b_cos double, b_sin double, b_cc double, b_ss double, b_cs double"
    quiet = frame(spark, [row], names).withColumns({f"{k}_{v}": F.lit(x) for k in "ab" for v, x in (("cc", 1e-12), ("ss", 1e-12), ("cs", 0.0))})
    out = {r.direction: r for r in resample.two_sight_amplitudes(quiet, [], ((-0.6, 0.8), (0.65, 0.75)), 50).collect()}
    assert out["east"].median == pytest.approx(np.hypot(*east), abs=1e-4) and out["up"].median == pytest.approx(np.hypot(*up), abs=1e-4)
    x, y = zip(*[(r.x, r.y) for r in spark.range(4000).select(*(c.alias(n) for c, n in zip(resample.normal_draws(1, F.col("id"), "k"), "xy", strict=True))).collect()], strict=True)
    assert abs(np.mean(x)) < 0.05 and abs(np.std(y) - 1) < 0.05 and abs(np.corrcoef(x, y)[0, 1]) < 0.05


def test_homogeneous_neighbours(spark):
    rng = np.random.default_rng(4)
    amp = {(r, c): rng.rayleigh(1.0 if c < 3 else 6.0, 60) for r in range(3) for c in range(6)}
    rows = [(r, c, [float(x) for x in v]) for (r, c), v in amp.items()] + [(9, 9, None), (9, 10, [1.0, None])]
    n = kernels.homogeneous(frame(spark, rows, "row int, col int, amp array<double>"), [], "row", "col", "amp", 1, 1)
    out = n.collect()
    assert len(out) == sum((r, c) != (q, d) and abs(r - q) <= 1 and abs(c - d) <= 1 for r, c in amp for q, d in amp)
    same = [r.alike for r in out if (r.col < 3) == (r.col2 < 3)]
    assert np.mean(same) > 0.85 and not any(r.alike for r in out if (r.col < 3) != (r.col2 < 3))
    img = frame(spark, [(r, c, *map(float, rng.normal(size=2))) for r, c in amp], "row int, col int, re double, im double").withColumns({"re2": F.col("re"), "im2": F.col("im")})
    assert all(r.coherence == pytest.approx(1) and r.n >= 1 for r in kernels.homogeneous_coherence(n, img, [], "row", "col", "re", "im", "re2", "im2").collect())


def test_best_shift_of_a_moved_field(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(14, 14))
    a = frame(spark, [(r, c, float(v[r, c])) for r in range(14) for c in range(14)], "row int, col int, v double")
    b = a.select((F.col("row") + 2).alias("row"), (F.col("col") - 1).alias("col"), F.col("v").alias("w"))
    assert tuple(spatial.best_shift(spatial.shift_scores(a, b, "row", "col", "v", "w", 3, stats.corr)).first())[:2] == (2, -1)
    assert spatial.best_shift(spatial.shift_scores(a.limit(0), b, "row", "col", "v", "w", 1, stats.corr)).count() == 0


def test_wet_delays(spark):
    water = frame(spark, [("s", f"2024-01-0{d} {h}:00:00", float(10 * d)) for d in (1, 2) for h in (10, 17)], "s string, t string, w double").withColumn("t", F.to_timestamp("t"))
    p = frame(spark, [("s", "2024-01-01", "2024-01-02"), ("s", "2024-01-02", "2024-01-09")], "s string, t1 string, t2 string").select("s", F.to_date("t1").alias("t1"), F.to_date("t2").alias("t2"))
    assert sorted((r.delay_mm or 0.0) for r in hydro.pair_wet_delays(p, water, ["s"], "t1", "t2", "t", "w", 17).collect()) == [0.0, pytest.approx(62.0)]


def test_envelope_of_a_line(spark):
    rows = [(float(i), 3.0 * i - (i % 10)) for i in range(1000)]
    assert stats.envelope_slope(frame(spark, rows, "x double, y double"), [], "x", "y", 10, 0.9).first().slope == pytest.approx(3, abs=0.01)
    assert stats.quantile_bins(frame(spark, [(1.0,)] * 5 + [(2.0,)], "x double"), [], "x", 4).select("bin").distinct().count() == 1


def test_taking_in_twice_changes_nothing_and_faults_are_not_hidden(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string").write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema("id long, x string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for k in "pq":
        live.take_in(stream(), f"{tmp_path}/out", "id", f"{tmp_path}/state-{k}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        live.take_in(stream(), f"{tmp_path}/bad", "id", f"{tmp_path}/state-r").awaitTermination()


def test_all_dates(spark):
    a = [("k", 0.0, 6.0, 12.0), ("k", 6.0, 12.0, 18.0), ("k", 100.0, 106.0, 112.0)]
    b = [("k", 1.6, 7.4, 13.5), ("k", 1.4, 7.5, 15.0), ("k", 7.6, 13.4, 19.4), ("k", 101.5, 108.5, 113.5)]
    f = lambda rows: frame(spark, rows, "k string, x double, y double, z double")
    got = {(r.a_x, r.b_x) for r in pairs.all_dates(f(a), f(b), ["k"], ["x", "y", "z"], 1.5, 0.6, 1).collect()}
    assert got == {(0.0, 1.6), (6.0, 7.6)}


def test_greedy_matching_against_the_plain_rule(spark):
    rng = random.Random(6)
    t = [(i, rng.choice([rng.uniform(0, 50), rng.uniform(80, 90), round(rng.uniform(0, 50))]), rng.randrange(5), rng.randrange(3)) for i in range(60)]
    c = [(i, rng.choice([rng.uniform(0, 50), rng.uniform(80, 90), round(rng.uniform(0, 50))]), 0, rng.randrange(3)) for i in range(60)] + [(99, None, 0, 1)]
    c = [(i, float(x) if x is not None else None, o, z) for i, x, o, z in c]
    t = [(i, float(x), o, z) for i, x, o, z in t]
    free, want = {x[0]: x for x in c if x[1] is not None}, set()
    for i, x, _, z in sorted(t, key=lambda r: (r[2], r[0])):
        near = [(abs(v - x), abs(q - z), j) for j, v, _, q in free.values() if abs(v - x) <= 1.5]
        if near:
            want.add((i, min(near)[2]))
            del free[min(near)[2]]
    names = "id int, x double, o int, z int"
    got = {(r.treated, r.control) for r in resample.nearest_matches(frame(spark, t, names), frame(spark, c, names), "id", "x", 1.5, "o", "z").collect()}
    assert got == want


def test_year_bootstrap(spark):
    df = frame(spark, [(y, float(y % 7 + k)) for y in range(2000, 2020) for k in range(3)], "y int, v double")
    out = resample.year_bootstrap(df, "y", lambda d: d.groupBy("draw").agg(F.avg("v").alias("m"), F.count("*").alias("n")), 40, 2).collect()
    assert len(out) == 40 and {r.n for r in out} == {60} and 0.1 < np.std([r.m for r in out]) < 0.9


def test_changes(spark):
    s = frame(spark, [("a", h * 3600, float(h)) for h in range(0, 200, 2)], "k string, t long, v double").withColumn("t", F.col("t").cast("timestamp"))
    q = frame(spark, [("a", 101 * 3600), ("a", 10 * 3600)], "k string, t long").withColumn("t", F.col("t").cast("timestamp"))
    out = sorted((r.x_at, r.x_d72h, r.x_d3h) for r in temporal.changes(q, s, ["k"], "t", "v", [72, 3], "x").select("x_at", F.coalesce("x_d72h", F.lit(-1.0)).alias("x_d72h"), "x_d3h").collect())
    assert out == [(10.0, -1.0, 3.0), (101.0, 72.0, 3.0)]


def test_joined_once(spark):
    a, b = frame(spark, [(1, "a"), (2, "b")], "k int, x string"), frame(spark, [(1, "c"), (3, "d")], "k int, y string")
    assert [tuple(r) for r in contracts.joined_once(a, b, ["k"]).collect()] == [(1, "a", "c")] and contracts.joined_once(a, b, ["k"], "full_outer").count() == 3
    with pytest.raises(Exception, match="twice"):
        contracts.joined_once(a, b.unionByName(b), ["k"], "left").collect()


def test_harmonic_covariance(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 5, 400))
    x = np.column_stack([np.ones(400), t, np.cos(2 * np.pi * t), np.sin(2 * np.pi * t)])
    y = x @ [1, 0.5, 3, -2] + rng.normal(0, 0.7, 400)
    r = stats.harmonic_covariance(frame(spark, [(float(a), float(b)) for a, b in zip(t, y, strict=True)], "t double, y double"), [], F.col("t"), F.col("y")).first()
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    cov = np.linalg.inv(x.T @ x) * rss[0] / 396
    assert [r.cos, r.sin, r.cc, r.ss, r.cs] == pytest.approx([beta[2], beta[3], cov[2, 2], cov[3, 3], cov[2, 3]], rel=1e-6)


def test_space_time_smoother_against_the_dense_system(spark):
    rng = np.random.default_rng(3)
    cells, t = [(0, 0), (0, 1), (1, 0), (5, 5)], np.arange(0, 60, 6)
    rows = [("s", r, c, int(t[i]), int(t[i + 1 + k]), 0.8, float(rng.normal()), 0.5) for r, c in cells for k in (0, 1) for i in range(len(t) - 1 - k)]
    df = frame(spark, rows, "site string, r int, c int, t1 int, t2 int, f double, y double, sd double")
    got = {(x.r, x.c, x.t): x.mean for x in kernels.space_time_smooth(df, ["site"], "r", "c", "t1", "t2", "f", "y", "sd", 20.0, 2.0, 0.7).collect()}
    q = np.linalg.inv(4 * np.exp(-np.abs(t[:, None] - t) / 20))
    lap = np.array([[2, -1, -1, 0], [-1, 1, 0, 0], [-1, 0, 1, 0], [0, 0, 0, 0]])
    p, b = np.kron(np.eye(4) + 0.7 * lap, q), np.zeros(4 * len(t))
    for _, r, c, a, z, f, y, sd in rows:
        d = np.zeros(4 * len(t))
        k = cells.index((r, c)) * len(t)
        d[k + z // 6], d[k + a // 6] = f, -f
        p += np.outer(d, d) / sd**2
        b += d * y / sd**2
    want = np.linalg.solve(p, b).reshape(4, -1)
    assert all(got[r, c, int(x)] == pytest.approx(want[k, n], abs=1e-6) for k, (r, c) in enumerate(cells) for n, x in enumerate(t))
    smooth = kernels.increment_smooth(df.withColumn("p", F.lit(1.0)), ["site", "r", "c"], "t1", "t2", "y", "sd", "p", 20.0, 2.0, 14.0)
    plain = kernels.ou_smooth(df, ["site", "r", "c"], "t1", "t2", "y", "sd", 20.0, 2.0)
    assert smooth.exceptAll(plain).count() == 0
    wide = kernels.increment_smooth(df.withColumn("p", F.lit(None).cast("double")), ["site", "r", "c"], "t1", "t2", "y", "sd", "p", 20.0, 2.0, 14.0)
    assert wide.agg(F.avg("sd")).first()[0] > 1.2 * plain.agg(F.avg("sd")).first()[0]


def test_transfer_of_a_trait(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 2, (80, 2))
    f = lambda v: np.sin(v[:, 0]) + 0.5 * v[:, 1]
    train = frame(spark, [([float(a) for a in v], float(w)) for v, w in zip(x, f(x) + rng.normal(0, 0.05, 80), strict=True)] + [(None, 1.0)], "v array<double>, y double")
    new = rng.uniform(-1.5, 1.5, (200, 2))
    out, skill = kernels.gp_transfer(frame(spark, [(i, [float(a) for a in v]) for i, v in enumerate(new)] + [(999, None)], "id int, v array<double>"), "id", "v", train, "v", "y")
    got = out.orderBy("id").toPandas()
    assert len(got) == 200 and np.sqrt(np.mean((got["mean"] - f(new)) ** 2)) < 0.1 and skill["skill"] > 0.95 and (got.sd > 0).all()
    with pytest.raises(ValueError):
        kernels.gp_transfer(out, "id", "mean", train, "v", "y", most=10)


def test_phase_filter_quiets_noise_and_keeps_holes(spark):
    rng = np.random.default_rng(2)
    r, c = np.indices((40, 50))
    ramp = 0.3 * c + 0.1 * r
    noisy = np.exp(1j * (ramp + rng.normal(0, 0.8, ramp.shape)))
    noisy[3, 4] = np.nan
    df = frame(spark, [("a", [float(v) for v in noisy.real.ravel()], [float(v) for v in noisy.imag.ravel()])], "k string, p array<double>, q array<double>")
    z = kernels.phase_filter(df, ["k"], "p", "q", 50, 0.8).first()
    out = (np.array(z.re, float) + 1j * np.array(z.im, float)).reshape(40, 50)
    off = lambda v: np.nanstd(np.angle(v * np.exp(-1j * ramp)))
    assert np.isnan(out[3, 4]) and np.isfinite(out).sum() == 1999 and off(out) < 0.6 * off(noisy)


def test_recursion_in_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=9000)
    df = frame(spark, [("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 2.0), ("b", 5, None)], "k string, d int, x double")
    for decay in (1.0, 0.9995, 0.5):
        a, want = 0.0, []
        for v in x:
            a = decay * a + 2 * v
            want.append(a)
        out = hydro.recursion(df, ["k"], "d", "x", decay, 2.0, "m").orderBy("k", "d").toPandas()
        np.testing.assert_allclose(out[out.k == "a"].m, want, rtol=1e-9, atol=1e-9)
        assert out[out.k == "b"].m.tolist() == [4.0, 4.0 * decay]
    with pytest.raises(ValueError):
        hydro.recursion(df, ["k"], "d", "x", 1.5, 1.0, "m")


def test_asof_without_a_tolerance_looks_across_blocks(spark):
    rng = random.Random(2)
    day = 86_400
    right = [(rng.choice("ab"), rng.randrange(0, 90) * day, i) for i in range(25)]
    left = [(rng.choice(["a", "b", None]), rng.randrange(-5, 100) * day + rng.randrange(day), i) for i in range(60)] + [("a", None, 99), ("c", 5, 98)]
    at = lambda df: df.withColumn("t", F.col("t").cast("timestamp"))
    ldf, rdf = at(frame(spark, left, "k string, t long, i int")), at(frame(spark, right, "k string, t long, v int"))
    for direction in ("backward", "forward", "nearest"):
        got = {r.i: r.v for r in temporal.asof(ldf, rdf, ["k"], "t", ["v"], None, direction, "v").collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            own = [(u, v) for q, u, v in right if q == k and t is not None]
            before = max(((u, v) for u, v in own if u <= t), default=None) if direction != "forward" else None
            after = min(((u, v) for u, v in own if u >= t), default=None) if direction != "backward" else None
            both = [(abs(x[0] - t), n, x[1]) for n, x in enumerate((before, after)) if x]
            assert got[i] == (min(both)[2] if both else None), (direction, k, t)
