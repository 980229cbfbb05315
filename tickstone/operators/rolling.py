"""Rolling totals over trailing periods, idle days included, by differences of running totals.

A running total that has taken up one huge value can no longer tell the small ones after it apart. Where a difference is lost in its
running total, the same total is put together from sums over 1, 2, 4... days, which leave nothing behind once a value is out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import day_text, finite
from tickstone.operators.readings import readings

#: share of a running total below which a difference of two of them has lost digits that matter
LOST = 2.0**-20


def rolling_totals(bars: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row for each symbol and calendar day from the first to the last day with a counted volume.

    ``symbol, activity_day (string), day_number (from 1), volume, n_volume``, and for each period n
    ``volume_n, active_n, close_sum_n, close_n_n, close_avg_n``. The trailing n days include the day itself; days before the first count as
    empty. A volume counts if finite and above zero, a close if finite; a day without either is idle, its totals
    are zero and an average over no close is null. Running totals are summed once per symbol over its days, carried
    forward over idle days, and subtracted at the window's ends, so a period's length costs nothing. Idle periods are told
    by the running count, which is exact. A total below ``LOST`` of its running total, or of one that is not finite, is summed by
    doubled spans instead, so a huge value matters only while it is in the period. A total beyond the range of doubles is infinite.
    Work: one exchange of the readings by (symbol, day), one of at most one row a symbol and day by symbol.
    """
    counts = finite("volume") & (F.col("volume") > 0)
    daily = (
        readings(bars, ["volume", "close"])
        .groupBy("symbol", "day")
        .agg(
            F.coalesce(F.sum(F.when(counts, F.col("volume"))), F.lit(0.0)).alias("volume"),
            F.count_if(counts).alias("n_volume"),
            F.coalesce(F.sum(F.when(finite("close"), F.col("close"))), F.lit(0.0)).alias("close"),
            F.count_if(finite("close")).alias("n_close"),
        )
        .where("n_volume > 0 or n_close > 0")
    )
    whole = Window.partitionBy("symbol")
    upto = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    active_day = F.when(F.col("n_volume") > 0, F.col("day"))
    summed = ("volume", "n_volume", "close", "n_close")
    prefix = (
        daily.withColumn("first", F.min(active_day).over(whole))
        .withColumn("last", F.max(active_day).over(whole))
        .where(F.col("day").between(F.col("first"), F.col("last")))
        .withColumns({f"p_{c}": F.sum(c).over(upto) for c in summed})
        .withColumn("until", F.coalesce(F.date_sub(F.lead("day").over(whole.orderBy("day")), 1), F.col("day")))
    )
    days = prefix.withColumn("at", F.explode(F.sequence("day", "until")))
    own = F.col("at") == F.col("day")
    order = whole.orderBy("at")

    def before(c: str, n: int) -> Column:
        return F.coalesce(F.lag(c, n).over(order), F.lit(0)) if n else F.col(c)

    days = days.withColumns({f"s_{c}_1": F.when(own, F.col(c)).otherwise(F.lit(0.0)) for c in ("volume", "close")})
    span = 1
    while 2 * span <= max(periods):
        days = days.withColumns({f"s_{c}_{2 * span}": F.col(f"s_{c}_{span}") + before(f"s_{c}_{span}", span) for c in ("volume", "close")})
        span *= 2

    def trailing(c: str, n: int) -> Column:
        return F.col(f"p_{c}") - before(f"p_{c}", n)

    def spans(c: str, n: int) -> Column:
        total, done = F.lit(0.0), 0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                total, done = total + before(f"s_{c}_{1 << bit}", done), done + (1 << bit)
        return total

    def total(c: str, n: int) -> Column:
        difference, running = trailing(c, n), F.abs(F.col(f"p_{c}"))
        kept = finite(f"p_{c}") & (F.abs(difference) >= running * F.lit(LOST))
        return F.when(trailing(f"n_{c}", n) == 0, F.lit(0.0)).when(kept, difference).otherwise(spans(c, n))

    out = {}
    for n in periods:
        out[f"volume_{n}"] = total("volume", n)
        out[f"active_{n}"] = trailing("n_volume", n)
        out[f"close_sum_{n}"] = total("close", n)
        out[f"close_n_{n}"] = trailing("n_close", n)
        out[f"close_avg_{n}"] = F.try_divide(total("close", n), trailing("n_close", n).cast("double"))
    return days.select(
        "symbol",
        day_text("at").alias("activity_day"),
        (F.datediff("at", "first") + 1).alias("day_number"),
        F.when(own, F.col("volume")).otherwise(F.lit(0.0)).alias("volume"),
        F.when(own, F.col("n_volume")).otherwise(F.lit(0)).alias("n_volume"),
        *(c.alias(k) for k, c in out.items()),
    )


def activity_marks(totals: DataFrame, short: int = 7, long: int = 30) -> DataFrame:
    """``symbol, activity_day, mark``: ``idle<short>``, ``idle<long>`` and ``surge``, from the ``long``-th day on."""
    marks = F.array_compact(
        F.array(
            F.when(F.col(f"active_{short}") == 0, F.lit(f"idle{short}")),
            F.when(F.col(f"active_{long}") == 0, F.lit(f"idle{long}")),
            F.when(F.col(f"volume_{short}") * 2 > F.col(f"volume_{long}"), F.lit("surge")),
        )
    )
    return totals.where(F.col("day_number") >= long).select("symbol", "activity_day", F.explode(marks).alias("mark"))
