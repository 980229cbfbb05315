"""A point-in-time store of bars: Parquet by year and month, append-only, the first row of a key stays."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tickstone.schemas import PIT_BAR, columns, struct
from tickstone.sources.storage import Lease, Storage

KEY = ["symbol", "event_time"]
MONTH = ["year", "month"]


def aware(at: datetime, what: str = "time") -> datetime:
    """``at`` in UTC; a time without zone is refused."""
    if at.tzinfo is None or at.utcoffset() is None:
        raise ValueError(f"{what} must have a time zone")
    return at.astimezone(UTC)


def visible(now: datetime) -> Column:
    """Rows that can be known at ``now``. Nothing is available before its event, so later events are left out as well,
    which lets the scan skip files."""
    at = F.lit(aware(now, "now"))
    return (F.col("available_at") <= at) & (F.col("event_time") <= at)


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row a key: the first by ``order``, which should leave no ties (``dropDuplicates`` would keep any)."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__k", first).where("__k = 1").drop("__k")


def new_keys(rows: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored.select(*key), list(key), "left_anti")


def month_range(start: datetime | None, end: datetime | None) -> Column | None:
    """Partitions that can hold events from ``start`` to ``end``; it prunes directories."""
    number = F.col("year") * 12 + F.col("month")
    parts = []
    for at, op in ((start, "ge"), (end, "le")):
        if at is not None:
            u = aware(at)
            edge = F.lit(u.year * 12 + u.month)
            parts.append(number >= edge if op == "ge" else number <= edge)
            parts.append(F.col("year") >= u.year if op == "ge" else F.col("year") <= u.year)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


class PitStore:
    """Bars under ``root/year=YYYY/month=MM`` on any storage that Spark reaches. One writer at a time, by a lease beside the store."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage = Storage(spark)
        self._schema = struct(PIT_BAR + ", year int, month int")

    def _stored(self) -> DataFrame:
        if not self.storage.any(f"{self.root}/year=*/month=*/*.parquet"):
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(self.root)

    def write(self, bars: DataFrame) -> int:
        """Append the rows whose (symbol, event_time) is not stored; returns their number.

        Of several rows of one key in ``bars`` the earliest available stays, then by the other columns. A row available before its
        event is refused, and so are columns of other types than the store's. Only the months of ``bars`` are read back, and only files with new rows are written, each sorted by
        event_time and symbol; a second write of the same rows adds nothing.
        """
        cols = columns(PIT_BAR)
        rows = bars.select(*cols)
        other = [f"{f.name} is {f.dataType.simpleString()}" for f in rows.schema if f.dataType != struct(PIT_BAR)[f.name].dataType]
        if other:
            raise TypeError(f"bars of another schema: {', '.join(other)}")
        if rows.where("available_at < event_time or available_at is null or event_time is null or symbol is null").limit(1).count():
            raise ValueError("every bar needs a symbol, and an available_at at or after its event_time")
        rows = rows.withColumns({"year": F.year("event_time"), "month": F.month("event_time")})
        with Lease(self.storage, f"{self.root}.lease").taken():
            months = [(r.year, r.month) for r in rows.select(*MONTH).distinct().collect()]
            if not months:
                return 0
            near = (F.col("year") * 12 + F.col("month")).isin([y * 12 + m for y, m in months])
            first = keep_first(rows, KEY, ["available_at", *[c for c in cols if c not in KEY and c != "available_at"]])
            fresh = new_keys(first, self._stored().where(near), KEY)
            seen = Observation()
            out = fresh.repartition(*MONTH, F.pmod(F.xxhash64("symbol"), F.lit(32))).sortWithinPartitions(*MONTH, "event_time", "symbol")
            out.observe(seen, F.count("*").alias("n")).write.mode("append").partitionBy(*MONTH).parquet(self.root)
            return int(seen.get["n"])

    def read(self, now: datetime, symbols: Sequence[str] | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Bars visible at ``now`` with ``start <= event_time < end``, ordered by event_time and symbol.

        ``symbols=None`` means all, an empty list none. A store without files gives no rows. Filters on event_time, on symbols
        and on the derived year and month reach the scan.
        """
        months = month_range(start, min(aware(now), aware(end)) if end else now)
        df = self._stored().where(months).where(visible(now))
        if symbols is not None:
            df = df.where(F.col("symbol").isin(list(symbols)))
        if start is not None:
            df = df.where(F.col("event_time") >= F.lit(aware(start, "start")))
        if end is not None:
            df = df.where(F.col("event_time") < F.lit(aware(end, "end")))
        return df.select(*columns(PIT_BAR)).orderBy("event_time", "symbol")

    def months(self) -> DataFrame:
        """``year, month, n``: the rows of each month, counted from the folders' names and the files' footers."""
        return self._stored().groupBy(*MONTH).agg(F.count("*").alias("n"))

    def coverage(self) -> DataFrame:
        """``rows, symbols, first, last`` of the whole store; nulls and zeros where it is empty."""
        return coverage(self._stored())


def coverage(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"), F.min("event_time").alias("first"), F.max("event_time").alias("last"))
