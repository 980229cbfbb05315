"""A New York exchange calendar from its public rules: sessions with opening and closing times in UTC."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession

NEW_YORK = ZoneInfo("America/New_York")
OPEN, CLOSE, EARLY = time(9, 30), time(16, 0), time(13, 0)
MONDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = 0, 3, 4, 5, 6


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    """The n-th such weekday of a month, counted from its end if n is negative."""
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    return last - timedelta(days=(last.weekday() - weekday) % 7 + 7 * (-n - 1))


def _easter(year: int) -> date:
    """Easter Sunday by the anonymous Gregorian computus."""
    golden, century = year % 19, year // 100
    skipped = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    moon = skipped - (skipped // 28) * (1 - (29 // (skipped + 1)) * ((21 - golden) // 11))
    week = (year + year // 4 + moon + 2 - century + century // 4) % 7
    days = moon - week
    month = 3 + (days + 40) // 44
    return date(year, month, days + 28 - 31 * (month // 4))


def _observed(day: date) -> date | None:
    """A fixed holiday's closed day: Monday for a Sunday, Friday for a Saturday."""
    return day + timedelta(days={SUNDAY: 1, SATURDAY: -1}.get(day.weekday(), 0))


def holidays(year: int) -> set[date]:
    """Full-day closures by the present rules; a New Year's Day on a Saturday is not made up for."""
    new_year = date(year, 1, 1)
    out = {
        _nth(year, 1, MONDAY, 3),
        _nth(year, 2, MONDAY, 3),
        _easter(year) - timedelta(days=2),
        _nth(year, 5, MONDAY, -1),
        _observed(date(year, 7, 4)),
        _nth(year, 9, MONDAY, 1),
        _nth(year, 11, THURSDAY, 4),
        _observed(date(year, 12, 25)),
    }
    if new_year.weekday() != SATURDAY:
        out.add(_observed(new_year))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return out


def short_sessions(year: int) -> set[date]:
    """Sessions that close early: before Independence Day and Christmas, and after Thanksgiving."""
    days = {date(year, 7, 3), date(year, 12, 24), _nth(year, 11, THURSDAY, 4) + timedelta(days=1)}
    return {d for d in days if d.weekday() < SATURDAY} - holidays(year)


def weekdays(start: date, end: date) -> Iterator[date]:
    """Monday to Friday from ``start`` to ``end``, both included."""
    for i in range((end - start).days + 1):
        d = start + timedelta(days=i)
        if d.weekday() < SATURDAY:
            yield d


def sessions(start: date, end: date, closed: Iterable[date] = ()) -> list[tuple[date, datetime, datetime]]:
    """Date, opening and closing instant of each session; ``closed`` adds single closures."""
    shut = set(closed)
    out = []
    for d in weekdays(start, end):
        if d in shut or d in holidays(d.year):
            continue
        close = EARLY if d in short_sessions(d.year) else CLOSE
        out.append((d, datetime.combine(d, OPEN, NEW_YORK), datetime.combine(d, close, NEW_YORK)))
    return out


def session_table(spark: SparkSession, start: date, end: date, closed: Iterable[date] = ()) -> DataFrame:
    """``session_date, open_utc, close_utc``."""
    return spark.createDataFrame(sessions(start, end, closed), "session_date date, open_utc timestamp, close_utc timestamp")
