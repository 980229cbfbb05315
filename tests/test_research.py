from __future__ import annotations

import math
import random
from datetime import UTC, date, datetime, timedelta

import pytest
from helpers import NAN, tuples
from pyspark.sql import functions as F

from tickstone.operators.evaluation import metrics, predict, split, train_baseline
from tickstone.operators.features import add_features, drawdown, momentum, trailing_mean, usable_labels
from tickstone.operators.series import in_pieces
from tickstone.operators.simulation import CostModel, fold, missing_next, session_terms, simulate, violations
from tickstone.operators.weights import Limits, decision, faulty_symbols, limited, top_equal
from tickstone.sources.files import synthetic_bars

PANEL = "symbol string, event_time timestamp, open double, close double, target_weight double, signal_available_at timestamp, adv_dollars double, annual_volatility double"


def test_demo_counts(spark):
    bars = synthetic_bars(spark).where("available_at <= timestamp'2023-06-30 23:59:00'")
    tick = F.lit("2023-06-30 23:59:00").cast("timestamp")
    f = usable_labels(add_features(bars), tick).cache()
    train, held = split(f, F.lit("2022-12-30 23:59:00").cast("timestamp"), F.lit(date(2023, 1, 3)), tick)
    assert (f.count(), train.count(), held.count()) == (4510, 3860, 640)
    m = metrics(predict(train_baseline(train, iterations=3), held)).first()
    assert m.n == 640 and 0 < m.rmse < 0.1
    with pytest.raises(ValueError):
        train_baseline(train.limit(0))


def test_features_brute(spark):
    rng = random.Random(1)
    closes = [round(rng.uniform(1, 2), 4) for _ in range(40)]
    closes[7] = 0.0
    df = spark.createDataFrame([("A", i, i, c) for i, c in enumerate(closes)], "symbol string, session int, available_at int, close double")
    got = add_features(df).orderBy("session").collect()
    rets = [None] + [b / a - 1 if a else None for a, b in zip(closes, closes[1:], strict=False)]
    for i, r in enumerate(got):
        assert r.ret_1 == rets[i] and r.target_available_at == (i + 1 if i < 39 else None)
        w = [x for x in rets[max(0, i - 19) : i + 1] if x is not None]
        if len(w) >= 10:
            mean = sum(w) / len(w)
            assert abs(r.vol_20 - math.sqrt(sum((x - mean) ** 2 for x in w) / (len(w) - 1))) < 1e-12
        else:
            assert r.vol_20 is None


def test_momentum_drawdown_mean(spark):
    df = spark.createDataFrame([("A", i, float(c)) for i, c in enumerate([1, 2, 4, 2, 8])], "symbol string, session int, close double")
    assert [r.momentum for r in momentum(df, 1, 3).orderBy("session").collect()] == [None, None, None, 3.0, 0.0]
    assert [r.drawdown for r in drawdown(df, "symbol", "session", "close").orderBy("session").collect()] == [0.0, 0.0, 0.0, 0.5, 0.0]
    assert [r.adv for r in trailing_mean(df, F.col("close"), 2).orderBy("session").collect()] == [None, 1.5, 3.0, 3.0, 5.0]


def test_metrics_of_constants_and_none(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, 1.0)], "prediction double, target_return double")
    m = metrics(df).first()
    assert (m.n, m.correlation) == (2, 0.0) and abs(m.rmse - math.sqrt(5)) < 1e-12
    assert metrics(df.limit(0)).first().n == 0


def test_top_equal(spark):
    s = spark.createDataFrame([(1, "b", 0.5), (1, " A", 0.5), (1, "c", 0.0), (1, "n", NAN), (1, "i", float("inf")), (1, "z", None), (2, "q", 1.0)], "tick int, symbol string, score double")
    assert tuples(top_equal(s, 2)) == [(1, "A", 1, 0.5), (1, "B", 2, 0.5), (2, "Q", 1, 1.0)]
    assert top_equal(s.limit(0)).count() == 0
    for bad in ([(1, "a", 1.0), (1, "A ", -1.0)], [(1, " ", 0.0)]):
        df = spark.createDataFrame(bad, "tick int, symbol string, score double")
        assert faulty_symbols(df, "tick").count() == 1
        with pytest.raises(Exception, match="duplicate symbol|blank symbol"):
            top_equal(df).collect()
        assert top_equal(df, check=False).count() <= 1
    with pytest.raises(ValueError):
        top_equal(s, 0)


WEIGHTS = "tick int, symbol string, weight double, sector string, adv double, current double"


def _limited(spark, rows, **kw):
    out = limited(spark.createDataFrame(rows, WEIGHTS), **kw)
    return {r.symbol: round(r.limited, 12) for r in out.collect()}, decision(out).first()


def test_limits_mix(spark):
    rows = [(1, s, 0.10, s, None, c) for s, c in (("A", 0.02), ("B", 0.0), ("C", 0.01))]
    got, d = _limited(spark, rows, current="current", sector="sector", drawdown=0.16, volatility=0.30)
    assert got == {"A": 0.01, "B": 0.0, "C": 0.005} and d.constraints == ["drawdown_no_new_buys", "max_name_weight", "volatility_target"]


def test_limits_liquidity_sector_gross(spark):
    got, d = _limited(spark, [(1, "A", 0.05, None, 1000.0, None), (1, "B", 0.05, None, 1000.0, None), (1, "C", 0.05, None, None, None), (1, "D", -1.0, None, None, None)], adv="adv", equity=1000.0)
    assert got == {"A": 0.01, "B": 0.01, "C": 0.0, "D": 0.0} and d.constraints == ["liquidity_cap", "long_only", "missing_adv"]
    got, d = _limited(spark, [(1, str(i), 0.05, "S", None, None) for i in range(10)], sector="sector")
    assert set(got.values()) == {0.03} and abs(d.gross - 0.3) < 1e-12 and d.constraints == ["max_sector_weight"]
    got, d = _limited(spark, [(1, str(i), 0.05, str(i), None, None) for i in range(40)], volatility=0.2)
    assert set(got.values()) == {0.025} and d.constraints == ["max_gross_weight", "volatility_target"]  # the smaller scale, not both
    for bad in ({"drawdown": 2.0}, {"volatility": 0.0}, {"adv": "adv"}):
        with pytest.raises(ValueError):
            _limited(spark, [(1, "A", 0.1, None, None, None)], **bad)
    with pytest.raises(ValueError):
        Limits(max_name_weight=1.5)


@pytest.mark.parametrize("bad, what", [([("A", 0.1), ("a ", 0.1)], "duplicate"), ([(" ", 0.1)], "blank"), ([(None, 0.1)], "blank"), ([("A", NAN)], "not finite"), ([("A", float("inf"))], "not finite"), ([("A", float("-inf"))], "not finite"), ([("A", None)], "not finite")])
def test_limits_refuse_bad_weights(spark, bad, what):
    rows = [(1, "B", 0.01, None, None, None), *((1, s, w, None, None, None) for s, w in bad)]
    df = limited(spark.createDataFrame(rows, WEIGHTS))  # nothing runs yet
    with pytest.raises(Exception, match=what):
        df.collect()
    with pytest.raises(Exception, match=what):
        decision(df).collect()


def test_a_hot_tick_is_ranked_and_limited_in_parts(spark):
    rows = [(1, f"S{i:05}", (i * 7919 % 10_007) / 10_007, "X" if i % 3 else None) for i in range(6000)] + [(None, "N", 0.5, None)]
    df = spark.createDataFrame(rows, "tick int, symbol string, score double, sector string")
    want = sorted((r for r in rows if r[0]), key=lambda r: (-r[2], r[1]))[:25]
    got = top_equal(df, 25).orderBy("rank").collect()
    assert [r.symbol for r in got if r.tick] == [r[1] for r in want] and all(abs(r.weight - 1 / 25) < 1e-15 for r in got if r.tick)
    assert [(r.symbol, r.weight) for r in got if r.tick is None] == [("N", 1.0)]
    out = limited(df.withColumnRenamed("score", "weight"), sector="sector")
    total = {r.tick: r.t for r in out.groupBy("tick").agg(F.sum("limited").alias("t")).collect()}
    assert out.count() == 6001 and abs(total[1] - 0.6) < 1e-9 and abs(total[None] - 0.05) < 1e-12


def _panel(spark, rows):
    return spark.createDataFrame(rows, PANEL)


def _day(n, hour=21):
    return datetime(2026, 1, 5, hour, tzinfo=UTC) + timedelta(days=n)


def test_simulation_golden(spark):
    rows = [("AAPL", _day(0), 100.0, 110.0, 0.5, _day(-3), 1e7, 0.2), ("AAPL", _day(1), 111.0, 122.1, 0.5, _day(0), 1e7, 0.2)]
    opens = spark.createDataFrame([(_day(n).date(), _day(n, 14)) for n in range(2)], "session_date date, open_utc timestamp")
    got = simulate(_panel(spark, rows), 1000.0, CostModel(0, 0, 0), opens).collect()
    assert [round(r.equity, 9) for r in got] == [1050.0, 1107.75] and [round(r.net_return, 9) for r in got] == [0.05, 0.055] and [r.transaction_costs for r in got] == [0, 0]
    late = [(*rows[0][:5], _day(0, 21), *rows[0][6:])]
    with pytest.raises(ValueError, match="signal after the open"):
        simulate(_panel(spark, late), opens=opens)
    with pytest.raises(ValueError, match="no session"):
        simulate(_panel(spark, rows), opens=opens.limit(0))


def _loop(rows, equity, cost):
    held, prev, out = {}, {}, []
    for t in sorted({r[1] for r in rows}):
        day = {r[0]: r for r in rows if r[1] == t}
        over = sum(w * (day[s][2] / prev[s] - 1) for s, w in held.items())
        e = equity * (1 + over)
        paid = turnover = 0.0
        for s, r in day.items():
            d = abs(r[4] - (held[s] * (r[2] / prev[s]) / (1 + over) if s in held else 0.0))
            turnover += d
            if d:
                paid += e * d * (cost.linear + cost.impact * r[7] * math.sqrt(e * d / r[6]))
        inside = sum(r[4] * (r[3] / r[2] - 1) for r in day.values())
        equity_new = (e - paid) * (1 + inside)
        held = {s: r[4] * r[3] / r[2] / (1 + inside) for s, r in day.items() if r[4] > 0}
        prev = {s: r[3] for s, r in day.items()}
        out.append((paid, turnover, equity_new / equity - 1, equity_new))
        equity = equity_new
    return out


def test_simulation_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"S{i}", _day(n), rng.uniform(9, 11), rng.uniform(9, 11), rng.choice([0.0, 0.05, 0.2]), _day(n - 2), rng.uniform(1e4, 1e6), 0.3) for n in range(30) for i in range(4)]
    cost = CostModel(1.0, 2.5, 0.1)
    got = [(r.transaction_costs, r.turnover, r.net_return, r.equity) for r in simulate(_panel(spark, rows), 5000.0, cost).collect()]
    for a, b in zip(got, _loop(rows, 5000.0, cost), strict=True):
        assert all(abs(x - y) <= 1e-9 * max(1, abs(y)) for x, y in zip(a, b, strict=True))


def test_runs_are_kept_apart(spark):
    rng = random.Random(5)
    rows = [(r, f"S{i}", _day(n), rng.uniform(9, 11), rng.uniform(9, 11), rng.choice([0.0, 0.05, 0.2]), _day(n - 2), rng.uniform(1e4, 1e6), 0.3) for r in ("x", "y") for n in range(12) for i in range(3)]
    both = spark.createDataFrame(rows, "run string, " + PANEL)
    got = fold(session_terms(both, run="run"), 100.0, "run").orderBy("run", "event_time").collect()
    for r in ("x", "y"):
        alone = fold(session_terms(both.where(F.col("run") == r)), 100.0).orderBy("event_time").collect()
        mine = [x for x in got if x.run == r]
        assert len(mine) == 12 and all(abs(a.equity - b.equity) < 1e-9 and a.event_time == b.event_time for a, b in zip(mine, alone, strict=True))


def test_a_hot_symbol_is_spread(spark):
    """A third of the rows under one symbol: the largest task holds no more than a piece of it."""
    rows = [("HOT", i, float(i + 1)) for i in range(20_000)] + [(f"S{i % 400}", i, float(i + 1)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "symbol string, session int, close double").withColumn("available_at", F.col("session"))
    sizes = []
    keep = lambda r, w: sizes.append(r.groupBy("symbol", "__piece").count()) or r
    assert in_pieces(df, "symbol", "session", 20, keep).count() == 60_000
    assert sizes[0].agg(F.max("count")).first()[0] <= 4096 + 2 * 20
    f = add_features(df)
    assert f.count() == 60_000 and f.where("symbol = 'HOT' and ret_5 is null").count() == 5 and f.where("symbol = 'HOT' and vol_20 is null").count() == 10
    d = drawdown(df.withColumn("close", -F.col("close")), "symbol", "session", "close")
    assert d.where("symbol = 'HOT'").agg(F.max("drawdown"), F.min("drawdown")).first() == (0.0, 1.0 - 20_000.0)
    nulls = df.union(spark.createDataFrame([(None, 1, 1.0, 1), ("A", None, 1.0, 1)], df.schema))
    assert add_features(nulls).count() == 60_000


def test_simulation_refuses(spark):
    ok = ("A", _day(0), 1.0, 1.0, 0.5, _day(-1), 1.0, 0.1)
    cases = {"blank": (" ", *ok[1:]), "invalid price": ("A", _day(0), NAN, *ok[3:]), "negative target": (*ok[:4], -0.1, *ok[5:]), "above 100%": (*ok[:4], 1.1, *ok[5:]), "adv_dollars": (*ok[:6], 0.0, 0.1), "annual_volatility": (*ok[:7], -1.0)}
    for what, row in cases.items():
        with pytest.raises(ValueError, match=what):
            simulate(_panel(spark, [row]))
    with pytest.raises(ValueError, match="duplicate"):
        simulate(_panel(spark, [ok, ("a ", *ok[1:])]))
    with pytest.raises(ValueError, match="no bar"):
        simulate(_panel(spark, [ok, ("B", _day(1), *ok[2:])]))
    with pytest.raises(ValueError, match="lacks columns"):
        violations(_panel(spark, [ok]).drop("open"))
    with pytest.raises(ValueError, match="not above zero"):
        simulate(_panel(spark, [(*ok[:4], 1.0, _day(-1), 1e-9, 5.0)]))
    assert simulate(_panel(spark, [])).count() == 0
    assert missing_next(_panel(spark, [ok])).count() == 0
    with pytest.raises(ValueError):
        fold(session_terms(_panel(spark, [ok])), 0.0)


def test_cost_is_monotone(spark):
    c = CostModel()
    r = spark.range(1).select(c.dollars(F.lit(100.0), F.lit(1e6), F.lit(0.2)).alias("a"), c.dollars(F.lit(10000.0), F.lit(1e6), F.lit(0.4)).alias("b"), c.rate(F.lit(100.0), F.lit(1e6), F.lit(0.2)).alias("r")).first()
    assert 0 < r.a < r.b and abs(r.a - 100 * r.r) < 1e-12
    with pytest.raises(ValueError):
        CostModel(impact=-1.0)
