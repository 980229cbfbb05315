"""Lag, lead and rolling features with labels that do not leak. Series are worked on in pieces, so a hot symbol is spread over tasks.

Rows without symbol or without a place in the order belong to no series and are left out of every result here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickstone.functions.columns import simple_return
from tickstone.operators.series import carried, in_pieces

FEATURES = ("ret_1", "ret_5", "vol_20")
#: rows before one that its features look at: 20 returns, the first of them from the row before
REACH = 20


def rolling_std(c: Column | str, order: WindowSpec, rows: int, least: int) -> Column:
    """Sample deviation of the last ``rows`` rows; null with fewer than ``least`` values or than two."""
    w = order.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))


def add_features(bars: DataFrame, key: str = "symbol", order: str = "session", close: str = "close", available: str = "available_at") -> DataFrame:
    """``bars`` with ``ret_1``, ``ret_5``, ``vol_20``, ``target_return`` and ``target_available_at``.

    Offsets count rows of a symbol in the order of ``order``. The target is the next row's return, known when that row is available. A
    zero close gives null. Filter by visibility first: then the last visible row has no target.
    """

    def made(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {
                "ret_1": simple_return(F.col(close), F.lag(close, 1).over(w)),
                "ret_5": simple_return(F.col(close), F.lag(close, 5).over(w)),
                "target_return": simple_return(F.lead(close, 1).over(w), F.col(close)),
                "target_available_at": F.lead(available, 1).over(w),
            }
        ).withColumn("vol_20", rolling_std("ret_1", w, 20, 10))

    return in_pieces(bars, key, order, REACH, made)


def usable_labels(features: DataFrame, tick: Column) -> DataFrame:
    """Rows whose target is known at ``tick`` and whose features and target are there. NaN is kept, null is not."""
    there = F.col("target_return").isNotNull()
    for f in FEATURES:
        there &= F.col(f).isNotNull()
    return features.where((F.col("target_available_at") <= tick) & there)


def momentum(bars: DataFrame, near: int = 21, far: int = 252, key: str = "symbol", order: str = "session", close: str = "close") -> DataFrame:
    """``momentum``: the return from ``far`` to ``near`` rows ago."""
    return in_pieces(bars, key, order, far, lambda rows, w: rows.withColumn("momentum", simple_return(F.lag(close, near).over(w), F.lag(close, far).over(w))))


def drawdown(curve: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``drawdown``: how far the value is below its highest so far, as a share of it."""
    high = carried(curve, key, order, "__peak", F.col(value), F.max, F.greatest)
    return high.withColumn("drawdown", F.lit(1.0) - F.try_divide(F.col(value), F.col("__peak"))).drop("__peak")


def buy_and_hold(bars: DataFrame, key: str = "symbol", order: str = "session", close: str = "close") -> DataFrame:
    """``order, symbols, growth``: what one unit, spread alike over all symbols at their first close, is worth at each time.

    A symbol counts from its first finite close above zero on; one without a bar at some time is left out of that time's mean.
    """
    usable = bars.where((F.col(close) > 0) & (F.col(close) < F.lit(float("inf"))))
    first = usable.groupBy(key).agg(F.min_by(close, order).alias("__first"))
    grown = usable.join(first, key).select(order, (F.col(close) / F.col("__first")).alias("g"))
    return grown.groupBy(order).agg(F.count("*").alias("symbols"), F.avg("g").alias("growth"))


def overnight_gap(bars: DataFrame, key: str = "symbol", order: str = "session", open_: str = "open", close: str = "close") -> DataFrame:
    """``gap``: the return from the row before's close to the open."""
    return in_pieces(bars, key, order, 1, lambda rows, w: rows.withColumn("gap", simple_return(F.col(open_), F.lag(close).over(w))))


def trailing_mean(bars: DataFrame, value: Column, rows: int = 20, key: str = "symbol", order: str = "session", name: str = "adv") -> DataFrame:
    """``name``: the mean of ``value`` over the last ``rows`` rows, null before there are as many."""

    def made(df: DataFrame, w: WindowSpec) -> DataFrame:
        last = w.rowsBetween(-(rows - 1), 0)
        return df.withColumn(name, F.when(F.count(value).over(last) == rows, F.avg(value).over(last)))

    return in_pieces(bars, key, order, rows, made)
