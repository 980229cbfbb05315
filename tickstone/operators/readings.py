"""One reading per (source, instant), laid out by (source, day) so that a busy source is split over its days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstone.functions.columns import norm_symbol, zone_day

FAR = "9999-12-31 00:00:00"


def readings(bars: DataFrame, fields: Sequence[str], zone: str = "America/New_York") -> DataFrame:
    """Rows ``symbol, day, event_time, <fields>``: of several deliveries the earliest available one counts.

    Rows without a symbol or ``event_time`` are dropped; a null ``available_at`` ranks last. Deliveries tied on
    ``available_at`` but with other values are decided by the fields' values in order (nulls first, NaN last), so
    the result is the same at every run. Extra columns are ignored. One exchange, by (symbol, day): the hottest
    key is one day of the busiest symbol, and later steps by (symbol, day) need no other exchange.
    """
    rows = bars.select(
        norm_symbol("symbol").alias("symbol"),
        zone_day("event_time", zone).alias("day"),
        F.col("event_time"),
        F.coalesce(F.col("available_at"), F.lit(FAR).cast("timestamp")).alias("__at"),
        *(F.col(f).cast("double").alias(f) for f in fields),
        # that a day is there is said as well: a join by day would else add it to one use of the exchange below and not to the others
    ).where(F.col("symbol").isNotNull() & F.col("event_time").isNotNull() & F.col("day").isNotNull())
    first = (
        rows.repartition("symbol", "day")
        .groupBy("symbol", "day", "event_time")
        .agg(F.min(F.struct("__at", *fields)).alias("__r"))
    )
    return first.select("symbol", "day", "event_time", *(F.col(f"__r.{f}").alias(f) for f in fields))
