"""Irregular readings onto a regular grid of sessions.

Harmonic seasonal regression with trend: each source's normal equations are sums over its observed grid points
(partial sums before the exchange), solved in batches of sources. A missing point gets the regression's value plus the
residuals of the observed points around it, joined by a straight line, so the series meets both endpoints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import day_text, usable
from tickstone.operators.readings import readings
from tickstone.session import small

#: (period in calendar days, number of harmonics): the week, whose five trading days two harmonics tell apart, and the year
YEAR = 365.25
SEASONS = ((7.0, 2), (YEAR, 1))
MAX_GRID = 100_000


def basis(days: Column, seasons: Sequence[tuple[float, int]] = SEASONS, scale: float = YEAR) -> list[Column]:
    """Constant, trend, and sine and cosine of each harmonic at a number of calendar days: a holiday shifts no weekday."""
    t = days.cast("double")
    out = [F.lit(1.0), t / F.lit(scale)]
    for period, n in seasons:
        for k in range(1, n + 1):
            w = t * F.lit(2 * math.pi * k / period)
            out += [F.sin(w), F.cos(w)]
    return out


def fit(points: DataFrame, key: str, y: str, xs: Sequence[Column], keep: Sequence[str] = (), ridge: float = 1e-6) -> DataFrame:
    """Rows ``key, beta, points``: least squares of ``y`` on ``xs`` for each key, and its points.

    ``points`` lists the columns ``keep`` of a key's rows in the order of the first of them. A key must have a bounded number of
    rows (here at most one a session). The normal equations are sums made in the JVM, before and after one exchange;
    Python sees one row a key, whose list passes through as it is. ``ridge`` times the number of rows is added on the diagonal but
    for the constant, which keeps short series solvable. Rows whose ``y`` is infinite or above 1e150 in size take no part in the
    sums (their squares leave the range of doubles).
    """
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    inside = F.abs(F.col(y)) < 1e150
    named = points.select(key, *{y, *keep}, *(F.when(inside, x).otherwise(0.0).alias(f"__x{i}") for i, x in enumerate(xs)), F.when(inside, F.col(y)).otherwise(0.0).alias("__y"))
    sums = named.groupBy(key).agg(
        F.array(*(F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i, j in pairs)).alias("xx"),
        F.array(*(F.sum(F.col(f"__x{i}") * F.col("__y")) for i in range(p))).alias("xy"),
        F.array_sort(F.collect_list(F.struct(*keep))).alias("points"),
    )
    at = np.array(pairs)
    kind = points.schema[key].dataType.simpleString()
    listed = sums.schema["points"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            xx = b.column("xx").flatten().to_numpy().reshape(n, len(at))
            xy = b.column("xy").flatten().to_numpy().reshape(n, p)
            a = np.zeros((n, p, p))
            a[:, at[:, 0], at[:, 1]] = xx
            a[:, at[:, 1], at[:, 0]] = xx
            pad = ridge * a[:, 0, 0]
            a[:, 0, 0] += a[:, 0, 0] == 0
            for i in range(1, p):
                a[:, i, i] += pad + 1e-12
            beta = np.linalg.solve(a, xy[..., None])[..., 0]
            lists = pa.ListArray.from_arrays(np.arange(0, n * p + 1, p, dtype=np.int32), beta.ravel())
            yield pa.RecordBatch.from_arrays([b.column(key), lists, b.column("points")], names=[key, "beta", "points"])

    return sums.mapInArrow(solve, f"`{key}` {kind}, beta array<double>, points {listed}")


def session_axis(sessions: DataFrame) -> DataFrame:
    """``day, step, t``: sessions numbered from 0, and the days since the first one. A calendar is small: its window runs in one task."""
    days = sessions.select(F.col("session_date").cast("date").alias("day")).where("day is not null").distinct()
    order = Window.orderBy("day")
    return days.withColumns({"step": F.row_number().over(order) - 1, "t": F.datediff("day", F.first("day").over(order))})


def session_values(bars: DataFrame, axis: DataFrame, field: str = "close") -> DataFrame:
    """Rows ``symbol, day, step, t, value, n``: the last usable reading of each session and the count of usable ones."""
    r = readings(bars, [field]).where(usable(field))
    per_day = r.groupBy("symbol", "day").agg(F.max_by(field, "event_time").alias("value"), F.count("*").alias("n"))
    return per_day.join(axis, "day")


def regular_grid(bars: DataFrame, sessions: DataFrame, field: str = "close") -> DataFrame:
    """One row for each symbol and session from the symbol's first to its last session with a usable value.

    ``symbol, session_date (string), value, fitted, filled, n_readings, gap``: ``fitted`` is the regression alone,
    ``filled`` marks sessions without a usable reading, whose ``value`` is estimated; ``gap`` is the length of the
    gap (0 where observed). Usable is neither null nor NaN. Readings on days without a session, rows without a
    symbol or time, and sessions given twice are ignored; a symbol with one session gives one row; empty tables give no
    rows. Where a neighbour is infinite the estimate is what the arithmetic gives.
    Work: one exchange of the readings by (symbol, day), one of at most one row a symbol and session by symbol.
    """
    axis = small(session_axis(sessions), MAX_GRID)
    points = session_values(bars, axis, field)
    fitted_keys = fit(points, "symbol", "value", basis(F.col("t")), ["step", "t", "value", "n"])

    def model(t: Column) -> Column:
        return sum((F.get(F.col("beta"), F.lit(i)) * c for i, c in enumerate(basis(t))), F.lit(0.0))

    pairs = fitted_keys.select("symbol", "beta", "points", F.posexplode("points").alias("__i", "here"))
    pairs = pairs.select("symbol", "beta", "here", F.get("points", F.col("__i") + 1).alias("next"))
    first, last = F.col("here.step"), F.coalesce(F.col("next.step") - 1, F.col("here.step"))
    residuals = {"res": F.col("here.value") - model(F.col("here.t")), "next_res": F.col("next.value") - model(F.col("next.t"))}
    at = pairs.withColumns(residuals).withColumn("at", F.explode(F.sequence(first, last)))
    own = F.col("at") == first
    share = F.try_divide((F.col("at") - first).cast("double"), (F.col("next.step") - first).cast("double"))
    bridge = F.col("res") * (F.lit(1.0) - share) + F.col("next_res") * share
    dates = axis.select(F.col("step").alias("at"), F.col("day").alias("session_day"), F.col("t").alias("at_t"))
    out = at.join(dates, "at").withColumn("fitted", model(F.col("at_t")))
    return out.select(
        "symbol",
        day_text("session_day").alias("session_date"),
        F.when(own, F.col("here.value")).otherwise(F.col("fitted") + bridge).alias("value"),
        "fitted",
        (~own).alias("filled"),
        F.when(own, F.col("here.n")).otherwise(F.lit(0)).alias("n_readings"),
        F.when(own, F.lit(0)).otherwise(F.col("next.step") - first - 1).alias("gap"),
    )
