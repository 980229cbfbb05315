from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
import pandas as pd
from helpers import NAN, at, bar, frame, tuples

from pyspark.sql import functions as F

from tickstone.operators.outliers import Limits, additive_outliers, departures, implausible, outlier_report
from tickstone.operators.readings import readings
from tickstone.operators.series import pieces, segment_median, whole_groups


def series(n=120, seed=1, sigma=0.01):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, sigma, n))), np.exp(rng.normal(10, 0.3, n))


def rows_of(symbol, close, volume, adj=None, open_=None):
    t0 = at("2025-01-02", 15)
    return [bar(symbol, t0 + timedelta(hours=i), None if c is None else float(c), None if v is None else float(v), 1.0 if adj is None else adj[i], None if open_ is None else open_[i]) for i, (c, v) in enumerate(zip(close, volume, strict=True))]


def found(spark, rows, limits=Limits(), field=None):
    t0 = at("2025-01-02", 15)
    df = implausible(frame(spark, rows), limits)
    out = [(r.symbol, round((r.event_us / 1e6 - t0.timestamp()) / 3600), r.field, r.kind) for r in df.collect()]
    return sorted(x for x in out if field is None or x[2] == field)


def test_each_kind(spark):
    c, v = series()
    flat_open = series(seed=9)[0].tolist()
    c[30] *= 10
    c[50], c[51] = c[50] * 1.5, c[51] * 0.5  # two at different levels
    c[60:] *= 0.5  # stays: a split
    c[80:87] = c[80]
    c[100] = -c[100]
    v[20], v[25] = v[20] * 1e5, 0.0
    v[40] = -v[40]
    adj = [1.0] * 120
    adj[10] = 37.5
    adj[60:] = [0.5] * 60
    got = found(spark, rows_of("A", c, v, adj, flat_open))
    assert got == sorted(
        [("A", 30, "close", "spike"), ("A", 50, "close", "spike"), ("A", 51, "close", "spike"), ("A", 100, "close", "limit"), ("A", 20, "volume", "spike"), ("A", 40, "volume", "limit"), ("A", 10, "adj_factor", "spike")]
        + [("A", i, "close", "stuck") for i in range(81, 87)]
    )


def test_quiet_fields_are_not_stuck(spark):
    c, v = series()
    c = np.round(c)
    c[1::2] = c[::2]
    c[40:48] = c[40]
    assert not [x for x in found(spark, rows_of("A", c, v), field="close") if x[3] == "stuck"]


def test_nulls_nans_and_zero_volumes_are_no_cases(spark):
    c, v = series()
    c, v = list(c), list(v)
    c[5], c[6] = None, NAN
    v[7], v[8] = None, NAN
    v[20:30] = [0.0] * 10
    assert found(spark, rows_of("A", c, v, [None] * 120)) == []


def test_short_and_constant_series(spark):
    rows = rows_of("A", [1.0], [5.0]) + rows_of("B", [2.0] * 4, [3.0] * 4) + rows_of("C", [0.0, -1.0], [0.0, 1.0])
    got = found(spark, rows)
    assert {x[:3] for x in got} == {("C", 0, "close"), ("C", 1, "close"), ("C", 0, "open"), ("C", 1, "open")}
    assert implausible(frame(spark, [])).count() == 0
    assert outlier_report(frame(spark, rows)).count() == 2


def test_pieces_give_what_one_piece_gives(spark):
    c, v = series(900, seed=4)
    rng = np.random.default_rng(8)
    for i in rng.choice(np.arange(5, 895), 25, replace=False):
        c[i] *= rng.choice([0.01, 100.0, 1.3])
    c[254:262] = c[254]  # over the edge of a piece
    c[600:] *= 3
    v[[100, 255, 256, 511]] *= 1e4
    rows = rows_of("A", c, v) + rows_of("B", *series(50, seed=5))
    whole = found(spark, rows, Limits(piece=4096))
    cut = found(spark, rows, Limits(piece=256, overlap=64))
    assert whole == cut and len(whole) > 30


def test_pieces_place_rows_exactly(spark):
    rows = []
    for s, n in (("A", 250), ("B", 7)):
        rows += rows_of(s, np.arange(n) + 1.0, np.ones(n))
    r = readings(frame(spark, rows), ["close"])
    p = pieces(r, "symbol", "day", "event_time", 50, 5).toPandas()
    core = p[p.core].sort_values(["symbol", "pos"])
    assert len(core) == 257 and (core.close - 1 == core.pos).all() and (core.pos // 50 == core.piece).all()
    a = p[(p.symbol == "A") & (p.piece == 2)]
    assert sorted(a.pos) == list(range(95, 155)) and set(p[p.symbol == "B"].piece) == {0} and set(p.total) == {250, 7} and not p.duplicated(["symbol", "piece", "pos"]).any()


def test_pieces_see_the_usable_rows_around_them(spark):
    n = 400
    rows = rows_of("A", [None if 90 <= i < 230 else i + 1.0 for i in range(n)], [1.0 if i % 7 == 0 else None for i in range(n)])
    r = readings(frame(spark, rows), ["close", "volume"])
    p = pieces(r, "symbol", "day", "event_time", 50, 5, {"c": F.col("close").isNotNull(), "v": F.col("volume").isNotNull()}).toPandas()
    for piece in range(8):
        mine = p[p.piece == piece]
        assert sorted(mine[mine.core].pos) == list(range(50 * piece, 50 * piece + 50))
        for c in ("close", "volume"):
            known = [i for i in range(n) if (not 90 <= i < 230 if c == "close" else i % 7 == 0)]
            seen = set(mine[mine[c].notna()].pos)
            assert set([i for i in known if i < 50 * piece][-5:]) <= seen and set([i for i in known if i >= 50 * piece + 50][:5]) <= seen


def test_whole_groups_and_medians():
    df = pd.DataFrame({"k": list("aabbbc"), "x": range(6)})
    got = [(list(f.k), list(s)) for f, s in whole_groups(iter([df.iloc[:1], df.iloc[1:4], df.iloc[4:4], df.iloc[4:]]), ["k"])]
    assert [k for f, _ in got for k in f] == list("aabbbc")
    assert all(len(set(f[i] for i in range(len(f)) if s[i] == g)) == 1 for f, s in got for g in set(s))
    seg, med = segment_median(np.array([3.0, 1.0, 2.0, 9.0]), np.array([0, 0, 0, 2]))
    assert list(seg) == [0, 2] and list(med) == [2.0, 9.0]
    assert list(segment_median(np.array([1.0, 5.0]), np.array([1, 1]), np.array([1.0, 3.0]))[1]) == [5.0]


def test_a_normal_value_between_two_spikes_is_kept():
    x = np.zeros(30)
    x[10], x[12] = 5.0, 5.0
    x += np.random.default_rng(0).normal(0, 0.01, 30)
    out = additive_outliers(x, np.zeros(30, int), np.full(30, 0.01), np.zeros(30), 10.0)
    assert list(np.flatnonzero(out)) == [10, 12]


def test_departures_are_those_beyond_the_limit():
    rng = np.random.default_rng(6)
    for _ in range(50):
        d, seg = rng.normal(0, 1, 200) * rng.choice([1, 1, 1, 30], 200), np.sort(rng.integers(0, 4, 200))
        phi = np.full(200, rng.choice([0.0, 0.2, 0.5]))
        assert list(departures(d, seg, np.full(200, 10.0), phi)) == list(np.abs(d) > 10.0)
    assert not departures(np.array([1e9]), np.zeros(1, int), np.array([np.inf]), np.zeros(1)).any() and len(departures(np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0))) == 0


def test_level_shift_and_edges_are_kept():
    x = np.r_[np.zeros(10), np.full(10, math.log(2))]
    x[0], x[-1] = 3.0, 3.0
    assert not additive_outliers(x, np.zeros(20, int), np.full(20, 0.01), np.zeros(20), 10.0).any()
    assert not additive_outliers(np.zeros(0), np.zeros(0, int), np.zeros(0), np.zeros(0), 10.0).any()


def test_hot_symbol_is_spread(spark):
    c, v = series(3000, seed=2, sigma=0.001)
    df = frame(spark, rows_of("HOT", c, v))
    sizes = pieces(readings(df, ["close"]), "symbol", "day", "event_time", 256, 64).groupBy("piece").count().toPandas()
    assert sizes["count"].max() <= 256 + 2 * 64 and len(sizes) == 12
    assert tuples(implausible(df, Limits(piece=256, overlap=64)).where("field = 'close'")) == []
