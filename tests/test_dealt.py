"""Trailing totals, the regular grid and implausible readings against plain Python on small cases."""

from __future__ import annotations

import itertools
import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quagmark.operators import regular, spikes, trailing
from quagmark.session import checkpointed

S = ["station", "plot"]


def hours(spark, rows):
    return spark.createDataFrame(rows, "station string, plot string, t timestamp, v timestamp, id long, rain double, snow boolean, hours int")


def test_trailing_hours_against_sums(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows, truth = [], {}
    for h in range(1200):
        if rng.random() < 0.15:
            continue
        for version in range(rng.choice([1, 1, 2])):
            rain, snow = rng.choice([None, 0.0, 0.0, 0.3, 2.1]), rng.choice([None, False, False, rng.random() < 0.1])
            rows.append(("A", "P", t0 + timedelta(hours=h), t0 + timedelta(days=90, minutes=version), len(rows), rain, snow, 7))
            truth[h] = (rows[-1][4], rain or 0.0, bool(snow))
    rows += [(None, "P", t0, t0, 10**6, 5.0, True, 7), ("A", "P", None, t0, 10**6, 5.0, True, 7), ("A", "Q", t0, None, -1, 1.0, True, 7)] + [("B", "P", t0, t0, 10**6 + 1, 1.0, False, 7)] * 50
    days = trailing.latest_hours(hours(spark, rows), S, "t", "v", "id", [trailing.amount("rain").alias("rain"), "snow"])
    out = trailing.trailing_hours(days, S, "rain", "snow", [1, 3, 7, 30], 3).collect()
    got = {r.hour.id: r for r in out}
    assert len(out) == len(truth) + 2 and got[-1].flagged and got[10**6 + 1].total_1d == 1_000_000
    for h, (i, _, _) in truth.items():
        for p in (1, 3, 7, 30):
            assert got[i][f"total_{p}d"] == round(sum(truth[k][1] for k in range(h - 24 * p + 1, h + 1) if k in truth) * 1e6)
        assert got[i].flagged == any(truth[k][2] for k in range(h - 71, h + 1) if k in truth)
    empty = trailing.latest_hours(hours(spark, []), S, "t", "v", "id", [trailing.amount("rain").alias("rain"), "snow"])
    assert trailing.trailing_hours(empty, S, "rain", "snow", [1, 3], 3).count() == 0


def test_trailing_totals_fill_days_without_rows(spark):
    d = date(2024, 2, 27)
    rows = [("A", "P", d, 5, 1), ("A", "P", d + timedelta(days=3), None, 0), ("A", "P", d + timedelta(days=9), 2, 0), (None, "P", d, 9, 9)]
    df = spark.createDataFrame(rows, "station string, plot string, day date, x long, y long")
    out = {r.day: (r.x_7d, r.x_30d, r.y_7d) for r in trailing.trailing_totals(df, S, "day", ["x", "y"], [7, 30]).collect()}
    assert len(out) == 10 and out[d] == (5, 5, 1) and out[d + timedelta(days=6)] == (5, 5, 1)
    assert out[d + timedelta(days=7)] == (0, 5, 0) and out[d + timedelta(days=9)] == (2, 7, 0)


def test_daily_grid(spark):
    d, p = date(2024, 2, 26), datetime(2024, 3, 1)
    rows = [
        ("A", "P", d, 1.0, 20, p), ("A", "P", d, 7.0, 0, p + timedelta(hours=1)),  # the later version is not usable
        ("A", "P", d + timedelta(days=1), 2.0, 3, p), ("A", "P", d + timedelta(days=1), 2.0, 3, p),
        ("A", "P", d + timedelta(days=5), 100.0, 24, None), ("A", "P", d + timedelta(days=6), 100.1, 24, p), (None, "P", d, 1.0, 1, p),
    ]
    df = spark.createDataFrame(rows, "station string, plot string, date date, cm double, n int, at timestamp")
    can = spark.createDataFrame([("A", "P", d + timedelta(days=2)), ("A", "P", d + timedelta(days=2)), ("A", "P", d + timedelta(days=1))], "station string, plot string, day date")
    usable = F.col("cm").between(-100, 100) & F.col("n").between(1, 24)
    out = [(r.day.day, r.value, r.filled, r.mark) for r in regular.daily_grid(df, S, "date", "at", "cm", ["n"], usable, can, 2).orderBy("day").collect()]
    assert out == [(26, None, None, "gap"), (27, 2.0, 2.0, "ok"), (28, None, 2.0, "refill"), (29, None, 2.0, "gap"), (1, None, None, "gap"), (2, 100.0, 100.0, "ok"), (3, None, 100.0, "gap")]
    assert regular.daily_grid(df.limit(0), S, "date", "at", "cm", ["n"], usable, can, 2).count() == 0


def test_days_with_takes_the_latest_row(spark):
    t, rows = datetime(2024, 1, 1, 5), []
    for k, ok in enumerate([True, True, False]):
        rows.append(("A", "P", t, t + timedelta(hours=k), ok))
    rows += [("A", "Q", t, t, True), ("A", "Q", t + timedelta(hours=1), t, None), ("A", "R", t, None, True), ("A", None, t, t, True)]
    df = spark.createDataFrame(rows, "station string, plot string, t timestamp, v timestamp, ok boolean")
    assert sorted(r.plot for r in regular.days_with(df, S, "t", "v", F.col("ok")).collect()) == ["Q", "R"]


def brute(values):
    v = [round(x * 10**9) for x in values]
    case, i = set(), 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] == v[i]:
            j += 1
        case |= set(range(i, j)) if j - i >= 12 else set()
        i = j
    case |= {k for k, x in enumerate(v) if abs(x) > 100 * 10**9}
    clean = [k for k in range(len(v)) if k not in case]
    if len(v) < 2:
        return case
    limit = 10 * float(np.median(np.abs(np.diff(v))))
    for n in (1, 2, 3):
        for s in range(1, len(clean) - n):
            own, before, after = [v[k] for k in clean[s : s + n]], v[clean[s - 1]], v[clean[s + n]]
            if min(own) - max(before, after) > limit or min(before, after) - max(own) > limit:
                case |= set(clean[s : s + n])
    return case


def test_implausible_against_brute_force(spark):
    rng = random.Random(11)
    t0, rows, truth = datetime(2024, 1, 1), [], set()
    for plot in "abcdef":
        x, values = 0.0, []
        while len(values) < 700:
            kind = rng.random()
            x += rng.choice([-0.2, -0.1, 0.0, 0.1, 0.2])
            if kind < 0.02:
                values += [x + rng.choice([-1, 1]) * rng.uniform(0.5, 30) for _ in range(rng.randint(1, 4))]
            elif kind < 0.03:
                values += [round(x, 2)] * rng.choice([5, 11, 12, 13, 400])
            elif kind < 0.04:
                values += [rng.choice([999.0, -9999.0, 100.0, 100.01, -100.0])]
            elif kind < 0.045:
                x += 40
            else:
                values.append(x)
        values = [round(y, 2) for y in values]
        first = len(rows)
        for k, y in enumerate(values):
            rows.append(("S", plot, t0 + timedelta(minutes=61 * k + (k > 300) * 50_000), first + k, y, None))
        truth |= {first + k for k in brute(values)}
    n = len(rows)
    rows += [(r[0], r[1], r[2], n + k, 55.5, None) for k, r in enumerate(rows[:50])] + [(None, "a", t0, n + 99, 999.0, None), ("S", "g", t0, n + 100, 999.0, 3.0), ("S", "h", None, n + 101, 999.0, None)]
    df = spark.createDataFrame(rows, "station string, plot string, t timestamp, id long, cm double, run double")
    out = spikes.implausible(df, S, "t", "id", ["cm", "run"], checkpointed).collect()
    assert {r.rec_id for r in out if r.field == "cm" and r.rule} == truth | {n + 100} and not [r for r in out if r.field == "run"]
    assert len(out) == len({r.rec_id for r in out}) and all(0.5 < r.p <= 1 for r in out)
    assert {r.state for r in out} == {"spike", "stuck", "out_of_range"} and [r for r in out if not r.rule]
    assert spikes.implausible(df.limit(0), S, "t", "id", ["cm"], checkpointed).count() == 0


def test_isolation_and_runs():
    row = np.zeros(6, int)
    assert spikes.run_lengths(np.array([1, 1, 2, 2, 2, 3]), np.array([0, 0, 0, 0, 1, 1])).tolist() == [2, 2, 2, 2, 1, 1]
    assert spikes.isolation(np.array([0.0, 5, 6, 0, -1, 0]), row).tolist()[1:3] == [5.0, 5.0]
    assert spikes.isolation(np.array([1.0, 2]), np.zeros(2, int)).tolist() == [-np.inf, -np.inf]


def model(out, run, stands, lengths, p=spikes.FIRST, counted=False):
    n = len(out)
    e = spikes.evidence(np.array(out, bool), np.array(run), np.array(stands, float), 12, np.tile(p, (n, 1)))
    return (*spikes.forward_backward(e, np.array(lengths), np.tile(p[3:].reshape(4, 4), (len(lengths), 1, 1)), counted), e)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(6)
    p = spikes.bounded(spikes.FIRST[None])[0]
    moves = p[3:].reshape(4, 4)
    lengths = [3, 1, 4]
    got, counts, e = model([False] * 8, [1, 2, 2, 1, 1, 3, 3, 3], rng.choice([0.0, 0.02, 0.3, 1.4], 8), lengths, p, True)
    for r, (start, n) in enumerate(zip([0, 3, 4], lengths, strict=True)):
        total, states, trans = 0.0, np.zeros((n, 4)), np.zeros((4, 4))
        for path in itertools.product(range(4), repeat=n):
            w = spikes.START[path[0]] * np.exp(sum(e[start + k, x] for k, x in enumerate(path))) * np.prod([moves[a, b] for a, b in itertools.pairwise(path)])
            total += w
            for k, x in enumerate(path):
                states[k, x] += w
            for a, b in itertools.pairwise(path):
                trans[a, b] += w
        np.testing.assert_allclose(got[start : start + n], states / total, atol=1e-9)
        np.testing.assert_allclose(counts[r], trans / total, atol=1e-9)


def test_what_the_rule_finds_the_model_finds_whatever_it_is_fitted_to():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p = spikes.bounded(np.concatenate([rng.normal(0, 5, (1, 3)), rng.dirichlet([0.1] * 4, 4).reshape(1, 16)], axis=1))[0]
        out, run, stands = (rng.random(40) < 0.1), np.where(rng.random(40) < 0.1, 12, rng.integers(1, 4, 40)), rng.choice([0.0, 0.05, 1.0001, 3.0, 50.0, np.inf], 40)
        run[out] = 1
        stands[out | (run >= 12)] = 0
        got, _, _ = model(out, run, stands, [40], p)
        assert (got[(stands > 1) | out | (run >= 12), spikes.NORMAL] < 0.5).all()


def test_a_fit_follows_the_series():
    rng = np.random.default_rng(2)
    n = 3000
    quiet, loud = rng.exponential(0.01, n), rng.exponential(0.06, n)
    loud[::20] = rng.exponential(5.0, n // 20) + 1.5
    fitted = []
    for stands in (quiet, loud):
        got, counts, _ = model([False] * n, [1] * n, stands, [n], counted=True)
        fitted.append(spikes.refitted(spikes.expected(got, counts, np.array([n]), np.ones(n), stands))[0])
    assert 0.008 < fitted[0][0] < 0.012 and 0.045 < fitted[1][0] <= 0.07
    assert fitted[1][3 + spikes.SPIKE] > 2 * fitted[0][3 + spikes.SPIKE]
