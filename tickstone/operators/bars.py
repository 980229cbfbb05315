"""Bars: from raw daily bars to point-in-time bars, from events to daily bars, and what is visible at many times at once."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickstone.functions.columns import DAY_US, zone_day
from tickstone.schemas import PIT_BAR, columns
from tickstone.session import small

ZONE = "America/New_York"
MOST_TICKS = 1_000


def close_of(day: Column | str, zone: str = ZONE, hour: int = 16) -> Column:
    """The instant of ``hour`` o'clock of a date in ``zone``."""
    d = F.col(day) if isinstance(day, str) else day
    wall = F.timestamp_micros(F.unix_date(d).cast("bigint") * DAY_US + hour * 3_600_000_000)
    return F.to_utc_timestamp(wall, zone)


def daily_to_pit(bars: DataFrame, sessions: DataFrame, vendor_delay: timedelta = timedelta(minutes=15)) -> DataFrame:
    """Raw daily bars stamped at their start as point-in-time bars stamped at the session's close.

    The session is the New York date of ``ts``; days that are no session close at 16:00 there. A bar is
    available ``vendor_delay`` (not negative) after the close. ``adj_factor`` is null, ``trade_count`` is dropped. The calendar is
    joined as a broadcast if its size is checked to be small.
    """
    if vendor_delay < timedelta(0):
        raise ValueError("vendor_delay must not be negative")
    days = small(sessions.select(F.col("session_date").cast("date").alias("day"), "close_utc").dropDuplicates(["day"]), 100_000)
    seconds = F.lit(vendor_delay.total_seconds())
    out = bars.withColumn("day", zone_day("ts", ZONE)).join(days, "day", "left")
    out = out.withColumn("event_time", F.coalesce("close_utc", close_of("day")))
    out = out.withColumn("available_at", F.col("event_time") + F.make_dt_interval(secs=seconds)).withColumn("adj_factor", F.lit(None).cast("double"))
    return out.select(*columns(PIT_BAR))


def daily_from_events(events: DataFrame) -> DataFrame:
    """``symbol, session, open, high, low, close, volume`` by day from events with a positive value.

    Open and close are the values of the first and last event of the day by (ts, event_id); volume counts the events.
    """
    at = F.struct("ts", "event_id")
    rows = events.where((F.col("value") > 0) & ~F.isnan("value"))
    return rows.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("session")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )


def visible_at_ticks(rows: DataFrame, ticks: DataFrame, key: str, at: str = "available_at", tick: str = "tick_at") -> DataFrame:
    """For each tick and key the last row available by then: ``rows`` as they stood at each of many times.

    No range join: rows are first reduced to the last one before each tick (summed up before the exchange, so a hot key
    costs at most a row a tick), which is then carried forward to the later ticks. Rows without ``at`` are never visible; keys without
    a row before a tick have none for it; of rows available at one instant the greatest by the other columns stands.
    ``ticks`` is a list of at most ``MOST_TICKS`` times.
    """
    payload = [c for c in rows.columns if c != key]
    times = sorted(r[0] for r in ticks.select(tick).where(F.col(tick).isNotNull()).distinct().limit(MOST_TICKS + 1).collect())
    if len(times) > MOST_TICKS:
        raise ValueError(f"more than {MOST_TICKS} ticks: give them in parts")
    kind = ticks.schema[tick].dataType
    listed = F.array(*(F.lit(t).cast(kind) for t in times)).cast(T.ArrayType(kind))
    # places in the list by two steps of about the root of its length: every so many first, then inside the stretch found
    stride = max(1, math.isqrt(len(times)))
    coarse = F.array(*(F.lit(t).cast(kind) for t in times[stride - 1 :: stride])).cast(T.ArrayType(kind))
    skipped = F.size(F.filter(coarse, lambda t: t < F.col(at))) * stride
    index = skipped + F.size(F.filter(F.slice(listed, skipped + 1, F.lit(stride)), lambda t: t < F.col(at)))
    kept = rows.where(F.col(at).isNotNull()).withColumn("__i", index).where(F.col("__i") < len(times))
    last = kept.groupBy(key, "__i").agg(F.max(F.struct(F.col(at).alias("__at"), F.struct(*payload).alias("row"))).alias("m"))
    upto = F.coalesce(F.lead("__i").over(Window.partitionBy(key).orderBy("__i")), F.lit(len(times))) - 1
    spread = last.withColumn("__upto", upto).withColumn("__t", F.explode(F.sequence("__i", "__upto")))
    return spread.select(key, F.get(listed, F.col("__t")).alias(tick), *(F.col(f"m.row.{c}").alias(c) for c in payload))
