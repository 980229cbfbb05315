from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from helpers import NAN, at, bar, frame, session_frame, tuples

from pyspark.sql import functions as F

from tickstone.operators.readings import readings
from tickstone.operators.regular_grid import SEASONS, fit, regular_grid
from tickstone.operators.rolling import activity_marks, rolling_totals


def test_readings_earliest_delivery_counts(spark):
    rows = [
        bar("abc ", "2025-01-03", 1.0, late=5),
        bar("ABC\t", "2025-01-03", 2.0, late=1),
        bar("abc", "2025-01-03", 3.0, late=None),
        bar("d e", "2025-01-03", 4.0),
        bar("d e", "2025-01-03", 4.0),
        bar(None, "2025-01-03"),
        bar(" ", "2025-01-03"),
        bar("X", None),
    ]
    got = tuples(readings(frame(spark, rows), ["close"]), "symbol", "close")
    assert got == [("ABC", 2.0), ("D.E", 4.0)]


def test_readings_ties_are_decided_by_value(spark):
    rows = [bar("A", "2025-01-03", c, late=1) for c in (3.0, 1.0, 2.0, NAN)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert tuples(readings(frame(spark, rows), ["close"]), "close") == [(1.0,)]


def test_day_is_new_yorks(spark):
    rows = [bar("A", at("2025-01-04", 2.0))]  # 21:00 of the 3rd there
    assert readings(frame(spark, rows), ["close"]).first().day == date(2025, 1, 3)


def _grid(spark, rows, **kw):
    out = regular_grid(frame(spark, rows), session_frame(spark, **kw))
    return {(r.symbol, r.session_date): r for r in out.collect()}


def test_grid_marks_gaps_and_meets_endpoints(spark):
    rows = [bar("A", "2025-01-02", 10.0), bar("A", "2025-01-03", NAN), bar("A", "2025-01-06", None), bar("A", "2025-01-07", 14.0), bar("A", "2025-01-11", 99.0), bar("B", "2025-01-06", 5.0)]
    got = _grid(spark, rows)
    assert [k for k, r in got.items() if r.filled] and {k for k, r in got.items() if r.filled} == {("A", "2025-01-03"), ("A", "2025-01-06")}
    assert got["A", "2025-01-02"].value == 10.0 and got["A", "2025-01-07"].value == 14.0
    assert got["A", "2025-01-03"].gap == 2 and got["B", "2025-01-06"].n_readings == 1
    assert ("A", "2025-01-11") not in got  # no session


def test_grid_value_is_regression_plus_bridge(spark):
    rng = np.random.default_rng(3)
    sessions = [r.session_date for r in session_frame(spark, n=60).orderBy("session_date").collect()]
    t = np.array([(d - sessions[0]).days for d in sessions])
    y = 50 + 0.1 * t + 2 * np.sin(2 * math.pi * t / 7) + rng.normal(0, 0.1, 60)
    missing = {7, 8, 20, 33, 34, 35}
    rows = [bar("A", str(d), float(v)) for i, (d, v) in enumerate(zip(sessions, y, strict=True)) if i not in missing]
    got = _grid(spark, rows, n=60)
    cols = [np.ones(60), t / 365.25]
    for p, n in SEASONS:
        for k in range(1, n + 1):
            cols += [np.sin(2 * math.pi * k * t / p), np.cos(2 * math.pi * k * t / p)]
    x = np.stack(cols, axis=1)
    seen = np.array([i not in missing for i in range(60)])
    a = x[seen].T @ x[seen]
    a[np.arange(1, x.shape[1]), np.arange(1, x.shape[1])] += 1e-6 * seen.sum() + 1e-12
    fitted = x @ np.linalg.solve(a, x[seen].T @ y[seen])
    res = np.interp(np.arange(60), np.flatnonzero(seen), (y - fitted)[seen])
    for i in missing:
        assert abs(got["A", str(sessions[i])].value - (fitted + res)[i]) < 1e-6
        assert abs(got["A", str(sessions[i])].value - y[i]) < 0.7


def test_grid_last_reading_of_a_session_and_odd_values(spark):
    rows = [bar("A", at("2025-01-02", 15), 1.0), bar("A", at("2025-01-02", 20), -2.0), bar("A", "2025-01-06", float("inf"))]
    got = _grid(spark, rows)
    assert got["A", "2025-01-02"].value == -2.0 and got["A", "2025-01-02"].n_readings == 2
    assert got["A", "2025-01-03"].filled and got["A", "2025-01-06"].value == float("inf")


def test_grid_empty_and_extra_columns(spark):
    assert regular_grid(frame(spark, []), session_frame(spark)).count() == 0
    df = frame(spark, [bar("A", "2025-01-02"), bar("A", "2025-01-06")])
    clash = df.selectExpr("*", "1 AS day", "2 AS step", "3 AS value", "4 AS n", "5 AS beta")
    assert regular_grid(clash, session_frame(spark)).where("filled").count() == 1
    none = session_frame(spark).limit(0)
    assert regular_grid(df, none).count() == 0


def test_fit_single_point_is_finite(spark):
    points = spark.createDataFrame([("a", 5.0, 1.0, 0.0)], "k string, y double, x0 double, x1 double")
    assert all(math.isfinite(v) for v in fit(points, "k", "y", [F.col("x0"), F.col("x1")], ["y"]).first().beta)


def _brute(rows, n):
    """Totals of n trailing days by going through all rows."""
    by = {}
    for s, when, _, _, _, _, c, v, *_ in rows:
        d = (when - timedelta(hours=5)).date()
        ok = v is not None and math.isfinite(v) and v > 0
        by.setdefault(s, []).append((d, v if ok else 0.0, int(ok), c))
    out = {}
    for s, xs in by.items():
        active = [d for d, _, ok, _ in xs if ok]
        if not active:
            continue
        d = min(active)
        while d <= max(active):
            w = [x for x in xs if max(min(active), d - timedelta(days=n - 1)) <= x[0] <= d]
            closes = [c for *_, c in w if c is not None and math.isfinite(c)]
            out[s, str(d)] = (sum(x[1] for x in w), sum(x[2] for x in w), sum(closes) / len(closes) if closes else None)
            d += timedelta(days=1)
    return out


def test_rolling_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for s in ("A", "B", "C"):
        for i in range(70):
            if rng.random() < (0.5 if s != "B" else 0.12):
                v = rng.choice([0.0, None, NAN, -5.0, float("inf"), 100.0, 250.0, 1e7])
                rows.append(bar(s, at(str(date(2025, 1, 2) + timedelta(days=i)), 20), rng.choice([1.5, 2.25, None, NAN]), v))
    got = {(r.symbol, r.activity_day): r for r in rolling_totals(frame(spark, rows)).collect()}
    for n in (7, 30):
        want = _brute(rows, n)
        assert set(got) == set(want)
        for k, (total, active, mean) in want.items():
            r = got[k]
            assert r[f"volume_{n}"] == total and r[f"active_{n}"] == active
            assert (r[f"close_avg_{n}"] is None) == (mean is None) and (mean is None or abs(mean - r[f"close_avg_{n}"]) < 1e-9)


@pytest.mark.parametrize("odd", [1e19, 1e300, 1.7e308])
def test_one_huge_value_leaves_with_its_window(spark, odd):
    days = [date(2025, 1, 2) + timedelta(days=i) for i in range(110)]
    rows = [bar("A", at(str(d), 20), odd if i == 20 else 2.5, odd if i in (20, 21) else 100.0) for i, d in enumerate(days)]
    got = {(date.fromisoformat(r.activity_day) - days[0]).days: r for r in rolling_totals(frame(spark, rows)).collect()}
    for i in (10, 60, 100):
        assert got[i].volume_7 == 700.0 and got[i].volume_30 == min(i + 1, 30) * 100.0 and got[i].close_avg_7 == 2.5 and got[i].close_sum_30 == min(i + 1, 30) * 2.5
    assert got[28].volume_7 == 700.0 and got[27].volume_7 == pytest.approx(odd) and got[51].volume_30 == 3000.0 and got[50].volume_30 == pytest.approx(odd)
    marks = {(r.activity_day, r.mark) for r in activity_marks(rolling_totals(frame(spark, rows))).collect()}
    assert (str(days[60]), "surge") not in marks and (str(days[29]), "surge") not in marks


def test_a_holiday_shifts_no_weekday(spark):
    sessions = [r.session_date for r in session_frame(spark, n=120).orderBy("session_date").collect()]
    shut = sessions[30]
    axis = session_frame(spark, n=120).where(F.col("session_date") != F.lit(shut))
    value = {d: 100.0 + 3.0 * d.weekday() for d in sessions if d != shut}
    left_out = {sessions[i] for i in (20, 45, 46, 47, 71, 99)}
    got = regular_grid(frame(spark, [bar("A", str(d), v) for d, v in value.items() if d not in left_out]), axis).where("filled").collect()
    assert {r.session_date for r in got} == {str(d) for d in left_out}
    assert all(abs(r.fitted - value[date.fromisoformat(r.session_date)]) < 0.05 for r in got)


def test_marks(spark):
    rows = [bar("A", "2025-01-02", volume=100.0), bar("A", "2025-03-02", volume=100.0), bar("B", "2025-01-02", volume=0.0)]
    marks = tuples(activity_marks(rolling_totals(frame(spark, rows))))
    days = [d for _, d, m in marks if m == "idle7"]
    assert days[0] == "2025-01-31" and days[-1] == "2025-03-01"
    assert [d for _, d, m in marks if m == "idle30"][0] == "2025-02-01"
    assert ("A", "2025-03-02", "surge") in marks and {s for s, *_ in marks} == {"A"}
    assert rolling_totals(frame(spark, [])).count() == 0
