"""Reading of text stamps."""

from __future__ import annotations

import itertools
import random
from datetime import UTC, datetime

import pytest

from quagmark.operators import timestamps as ts

T0 = datetime(2020, 3, 18, 3, 47, 42, tzinfo=UTC)


def us(t: datetime) -> int:
    return int(t.timestamp()) * 1_000_000 + t.microsecond


def read(text, zone="UTC", place="Europe/Warsaw", order="DMY", day=None):
    return sorted({u for u, _, ok in ts.interpretations(text, zone, place, order, day) if ok})


SAME = [
    "2020-03-18T03:47:42Z", "2020-03-18 03:47:42z", " 2020-03-18 03:47:42Z  ", "20200318T034742Z", "20200318034742", "2020-078T03:47:42Z", "2020078T034742Z", "2020-W12-3T03:47:42Z",
    "2020-03-18T04:47:42+01:00", "2020-03-18 04:47:42 +0100", "2020-03-18T04:47:42+01", "Wed, 18 Mar 2020 04:47:42 +0100", "18 Mar 2020 03:47:42 GMT", "18-Mar-2020 03:47:42", "March 18, 2020 3:47:42 AM",
    "18/03/2020 3:47:42 am", "18.03.2020 03:47:42", "1584503262", "1584503262000", "2020-03-18 04:47:42 Europe/Warsaw", "2020-03-18 04:47:42 CET", "2020-03-18 03:47:42 UTC+0", "18 March 2020 03:47:42 UTC", "2020/03/18 03:47:42",
]


@pytest.mark.parametrize("text", SAME)
def test_notations_of_one_instant(text):
    assert read(text) == [us(T0)]


def test_fractions_and_omitted_parts():
    assert read("2020-03-18 03:47:42,439Z") == [us(T0) + 439_000]
    assert read("2020-03-18T03:47:42.152867Z") == [us(T0) + 152_867]
    assert read("2020-03-18T03:47Z") == [us(T0) - 42_000_000]
    assert read("2020-03-18T03.5Z") == [us(datetime(2020, 3, 18, 3, 30, tzinfo=UTC))]
    assert read("2020-03-18T24:00Z") == [us(datetime(2020, 3, 19, tzinfo=UTC))]


@pytest.mark.parametrize("text", [None, "", "   ", "n/a", "NaT", "-9999", "--:--", "2019-02", "Feb 2019", "31.04.2019", "31.04.2019 10:00", "2019-02-30T03:20:06Z", "2025-06-16T28:34:44Z", "2021-03-23T16:98:00Z", "2024-14-19 03:38:39Z", "02:40", "Thu, 18 Mar 2020 03:47:42 +0000", "2020-03-18T24:01Z", "13:00 PM", "x" * 100_000, "9999999999", "2030-01-01T00:00Z", "2020-03-18 03:47 XYZT"])
def test_undecidable(text):
    assert read(text) == []


def test_numeric_dates_follow_the_order():
    assert read("03/04/2021 10:00", order="DMY") == [us(datetime(2021, 4, 3, 10, tzinfo=UTC))]
    assert read("03/04/2021 10:00", order="MDY") == [us(datetime(2021, 3, 4, 10, tzinfo=UTC))]
    assert len(read("03/04/2021 10:00", order=None)) == 2


def test_clock_changes():
    assert read("2024-03-31 02:30:00", zone="Europe/Warsaw") == []
    assert len(read("2024-10-27 02:30:00", zone="Europe/Warsaw")) == 2
    assert read("2024-10-27 02:30 CEST") == [us(datetime(2024, 10, 27, 0, 30, tzinfo=UTC))]
    assert read("2024-11-03 01:22 EST", place="America/Toronto") == [us(datetime(2024, 11, 3, 6, 22, tzinfo=UTC))]
    assert read("2024-11-03 01:22 EST", place="Australia/Hobart") == [us(datetime(2024, 11, 2, 15, 22, tzinfo=UTC))]


def test_bare_times_belong_to_the_day():
    day = 18339
    assert read("02:40", day=day) == [us(datetime(2020, 3, 18, 2, 40, tzinfo=UTC))]
    assert read("0240", day=day) == [us(datetime(2020, 3, 18, 2, 40, tzinfo=UTC))]
    assert read("T03", day=day) == read("3 AM", day=day) == [us(datetime(2020, 3, 18, 3, tzinfo=UTC))]
    assert read("0240-05", day=day) == [us(datetime(2020, 3, 18, 7, 40, tzinfo=UTC))]
    assert read("02:40:10.5Z", day=day) == [us(datetime(2020, 3, 18, 2, 40, 10, 500_000, tzinfo=UTC))]


@pytest.mark.parametrize("text", ["2019-02", "2023-11", " 2021-12", "2020-01", "Feb 2019", "31.04.2019", "??2019", "-9999"])
def test_a_month_is_no_time_of_the_day(text):
    assert read(text, day=18339) == []


def test_long_texts():
    assert read("2020-03-18" + " " * 100_000 + "03:47:42" + " " * 50_000 + "Z") == [us(T0)]
    assert read("2020-03-18T03:47:42." + "9" * 20_000 + "Z") == [us(T0) + 999_999]
    assert read("2020-03-18T03:47:42" + " x" * 50_000) == []


def test_viterbi_prefers_few_switches_and_forward_time():
    a, b = us(datetime(2021, 4, 3, tzinfo=UTC)), us(datetime(2021, 3, 4, tzinfo=UTC))
    first = (us(datetime(2021, 3, 20, tzinfo=UTC)), "numeric_dmy", True)
    states = [[first], [(a, "numeric_dmy", True), (b, "numeric_mdy", True)], [], [(a + 1, "numeric_dmy", False), (a + 2, "numeric_mdy", True)]]
    assert [k for k, _ in ts.best_path(states)] == [0, 0, -1, 1]
    margins = [m for _, m in ts.best_path(states)]
    assert margins[0] == float("inf") and ts.ORDER_MARGIN <= margins[1] < ts.CONVENTION_MARGIN <= margins[3]


def test_margins_against_all_paths():
    rng = random.Random(8)
    for _ in range(60):
        states = [[(rng.randrange(6), rng.choice("ab"), rng.random() < 0.7) for _ in range(rng.randrange(0, 4))] for _ in range(5)]
        known = [s for s in states if s]

        def cost(path):
            c = sum(0 if x[2] else ts.AGAINST_CONVENTION for x in path)
            return c + sum(ts.NOTATION_SWITCH * (p[1] != q[1]) + ts.BACK_IN_TIME * (q[0] < p[0]) for p, q in itertools.pairwise(path))

        paths = [(cost(p), p) for p in itertools.product(*known)]
        got = [(s[k], m) for s, (k, m) in zip(states, ts.best_path(states), strict=True) if s]
        for at, (x, margin) in enumerate(got):
            best = min(c for c, _ in paths)
            assert min(c for c, p in paths if p[at][0] == x[0]) == best
            assert margin == min((c for c, p in paths if p[at][0] != x[0]), default=float("inf")) - best


def test_record_order_settles_what_conventions_leave_open(spark):
    from pyspark.sql import functions as F

    # an hour shown twice, in records that are in order of time: the first of the two before a reading of the first pass, the second after one
    texts = ["2024-10-27T00:10Z", "2024-10-27 02:20", "2024-10-27T00:40Z", "2024-10-27T01:15Z", "2024-10-27 02:30", "2024-10-27T01:50Z", "2024-10-27 02:55"]
    df = spark.createDataFrame([(i, "A", x) for i, x in enumerate(texts)], "id long, source string, text string")
    slim = ts.stamps(df, "t", "id", "text", ["source"], zone=F.lit("Europe/Warsaw"))
    hour = lambda r: None if r.epoch_us is None else (r.epoch_us - us(datetime(2024, 10, 27, tzinfo=UTC))) // 60_000_000
    assert {r.rec_id: hour(r) for r in ts.resolve(slim).collect()} == {0: 10, 1: None, 2: 40, 3: 75, 4: None, 5: 110, 6: None}
    assert {r.rec_id: hour(r) for r in ts.resolve(slim, least_margin=ts.ORDER_MARGIN).collect()} == {0: 10, 1: 20, 2: 40, 3: 75, 4: 90, 5: 110, 6: 115}


def test_resolve_keeps_every_row(spark):
    rows = [(1, "A", "2020-03-18T03:47:42Z", 9), (1, "A", "2020-03-18T03:47:42Z", 9), (2, None, "nonsense", 9), (3, "B", None, 9), (4, "B", "03/04/2021 10:00", 9)]
    df = spark.createDataFrame(rows, "id long, source string, text string, tab int")
    out = ts.resolve(ts.stamps(df, "t", "id", "text", ["source"])).collect()
    assert sorted((r.rec_id, r.decided) for r in out) == [(1, False), (1, False), (2, False), (3, False), (4, False)] or len(out) == 5
    from pyspark.sql import functions as F

    out = ts.resolve(ts.stamps(df, "t", "id", "text", ["source"], zone=F.lit("UTC"), date_order=F.lit("DMY")))
    assert sorted((r.rec_id, r.epoch_us) for r in out.collect() if r.decided) == [(1, us(T0)), (1, us(T0)), (4, us(datetime(2021, 4, 3, 10, tzinfo=UTC)))]
    assert ts.resolve(ts.stamps(df.limit(0), "t", "id", "text", ["source"])).count() == 0
