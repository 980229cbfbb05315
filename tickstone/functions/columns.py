"""Column expressions: spelling, dates, finite numbers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v "
DAY_US = 86_400_000_000
AS_OF_FORMATS = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim blanks of every kind, tabs and line ends too; null stays null."""
    return F.btrim(col(c), F.lit(BLANKS))


def norm_symbol(c: Column | str) -> Column:
    """Trimmed, upper case, an inner space written as ``.``; null and blank give null."""
    return F.nullif(F.upper(F.replace(strip(c), F.lit(" "), F.lit("."))), F.lit(""))


def norm_source(c: Column | str) -> Column:
    """Trimmed, lower case, ``_`` for a space; null and blank give null."""
    return F.nullif(F.lower(F.replace(strip(c), F.lit(" "), F.lit("_"))), F.lit(""))


def norm_path(c: Column | str) -> Column:
    """Trimmed, without a leading ``./`` however often it is repeated."""
    p = strip(c)
    return F.when(F.startswith(p, F.lit("./")), F.regexp_replace(p, r"^(\./)+", "")).otherwise(p)


def norm_hash(c: Column | str) -> Column:
    """Trimmed, lower case, without the prefix ``sha256:``."""
    h = F.lower(strip(c))
    return F.when(F.startswith(h, F.lit("sha256:")), F.substring(h, 8, 1 << 30)).otherwise(h)


def parse_day(c: Column | str) -> Column:
    """A date written in any of ``AS_OF_FORMATS``; what fits none gives null."""
    return F.coalesce(*(F.try_to_timestamp(strip(c), F.lit(f)).cast("date") for f in AS_OF_FORMATS))


def zone_day(ts: Column | str, zone: str = "America/New_York") -> Column:
    """The calendar date of an instant in ``zone``, whatever the session's time zone."""
    us = F.unix_micros(F.from_utc_timestamp(col(ts), zone))
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(DAY_US))) / DAY_US).cast("int"))


def day_text(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite. A bare ``>`` keeps NaN, which Spark orders above all numbers."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def usable(c: Column | str) -> Column:
    """Neither null nor NaN."""
    return col(c).isNotNull() & ~F.isnan(col(c))


def simple_return(a: Column | str, b: Column | str) -> Column:
    """``a / b - 1``; null where ``b`` is zero (ANSI division would raise)."""
    return F.try_divide(col(a), col(b)) - F.lit(1.0)
