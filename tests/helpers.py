"""Small tables in the shape of the real ones."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

BARS = "symbol string, event_time timestamp, available_at timestamp, open double, high double, low double, close double, volume double, vwap double, adj_factor double"
NAN = float("nan")


def at(day: str, hour: float = 21.0) -> datetime:
    return datetime.fromisoformat(f"{day}T00:00:00+00:00") + timedelta(hours=hour)


def bar(symbol, when, close=100.0, volume=1000.0, adj=1.0, open_=None, late=0.25):
    when = at(when) if isinstance(when, str) else when
    seen = None if late is None or when is None else when + timedelta(hours=late)
    o = close if open_ is None else open_
    return (symbol, when, seen, o, o, o, close, volume, None, adj)


def frame(spark, rows):
    return spark.createDataFrame(rows, BARS)


def session_frame(spark, first="2025-01-02", n=40):
    d, out = date.fromisoformat(first), []
    while len(out) < n:
        if d.weekday() < 5:
            out.append((d, datetime(d.year, d.month, d.day, 14, 30, tzinfo=UTC), datetime(d.year, d.month, d.day, 21, 0, tzinfo=UTC)))
        d += timedelta(days=1)
    return spark.createDataFrame(out, "session_date date, open_utc timestamp, close_utc timestamp")


def tuples(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
