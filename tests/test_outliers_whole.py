"""What series in several pieces must share with those in one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from helpers import frame
from pyspark.sql import functions as F
from test_outliers import found, rows_of, series

from tickstone.operators.outliers import FIELDS, Limits, series_statistics, needed_values
from tickstone.operators.readings import readings
from tickstone.operators.series import pieces

CUT = Limits(piece=256, overlap=64)


def test_calm_volumes_of_a_long_series_have_spikes(spark):
    c, _ = series(900, seed=4)
    v = np.exp(10 + np.random.default_rng(3).normal(0, 0.001, 900))
    v[[100, 255, 700]] *= 1.5
    rows = rows_of("A", c, v)
    assert found(spark, rows, field="volume") == [("A", i, "volume", "spike") for i in (100, 255, 700)]
    assert found(spark, rows, CUT, field="volume") == found(spark, rows, field="volume")


def test_unusable_values_at_an_edge_hide_nothing(spark):
    """Pieces of 256, of 4,096 and of any length give the same rows, with a hundred nulls, zeros or negative values at an edge."""
    c, v = series(900, seed=4)
    c, v, adj = c.tolist(), v.tolist(), [1.0] * 900
    open_ = series(900, seed=7)[0].tolist()
    for i in (250, 253, 257, 260, 513, 770):
        c[i] *= 5
        open_[i] *= 7
        v[i] *= 1e5
        adj[i] = 37.5
    c[206:254] = [None] * 48  # the spike's neighbours are far away
    c[258:360] = [None] * 102
    adj[200:255], adj[258:400] = [None] * 55, [None] * 142
    open_[420:509] = [0.0] * 89
    open_[516:620] = [-1.0] * 104
    v[660:768], v[771:880] = [0.0] * 108, [float("nan")] * 109
    c[640:646] = [c[640]] * 6
    c[765:767], c[767:769], c[769:774] = [c[764]] * 2, [None] * 2, [c[764]] * 5  # a run over an edge, with holes
    rows = rows_of("A", c, v, adj, open_)
    whole = found(spark, rows, Limits(piece=10**9))
    assert found(spark, rows, CUT) == whole == found(spark, rows, Limits())
    assert {("A", 257, "adj_factor", "spike"), ("A", 513, "open", "spike"), ("A", 770, "volume", "spike"), ("A", 770, "close", "stuck")} <= set(whole)


def test_medians_of_a_long_series_are_exact(spark):
    rows = []
    for k, (n, sigma, digits) in enumerate([(900, 0.01, 9), (901, 0.0001, 9), (1500, 0.02, 2), (257, 0.01, 0), (40, 0.01, 9)]):
        c, v = series(n, seed=k, sigma=sigma)
        rows += rows_of(f"S{k}", np.round(c, digits), np.round(v, -3), open_=np.round(series(n, seed=k + 50)[0], digits).tolist())
    r = readings(frame(spark, rows), FIELDS).withColumn("pos_us", F.unix_micros("event_time")).drop("event_time")
    cut, whole = (series_statistics(pieces(r, "symbol", "day", "pos_us", x.piece, x.overlap, needed_values()), x).toPandas().sort_values("symbol", ignore_index=True) for x in (CUT, Limits()))
    pd.testing.assert_frame_equal(cut, whole, check_exact=True)


def test_a_series_without_statistics_keeps_its_other_cases(spark):
    adj = [1.0] * 6
    adj[3] = 37.5
    got = found(spark, rows_of("Z", [0.0] * 6, [0.0] * 6, adj) + rows_of("N", [None] * 6, [None] * 6, adj))
    limits = [("Z", i, f, "limit") for i in range(6) for f in ("close", "open")]
    assert got == sorted([*limits, ("Z", 3, "adj_factor", "spike"), ("N", 3, "adj_factor", "spike")])
