"""Totals, ranks and windows by keys of which one may hold a third of the rows: no group is gathered into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: parts into which a group is cut by hash
SALTS = 64


def salt(*by: Column | str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def with_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """``rows`` with the other columns of ``totals``, which has one row for each value of ``keys`` (nulls are a value).

    The totals are repeated for each part of a group, and a group's rows are cut by hash of ``by``, so a hot group is joined by many tasks.
    """
    named = totals.select(*(F.col(k).alias(f"__t_{k}") for k in keys), *(c for c in totals.columns if c not in keys))
    each = named.withColumn("__t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col("__salt") == F.col("__t_salt")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    out = rows.withColumn("__salt", salt(by)).join(each, same)
    return out.drop("__salt", "__t_salt", *(f"__t_{k}" for k in keys))


def first_of(rows: DataFrame, key: str, order: Sequence[Column], most: int, by: str, rank: str = "rank") -> DataFrame:
    """The first ``most`` rows of each ``key`` by ``order``, with their ``rank``: first of each part of a group, then of those."""
    part = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(*order))
    few = rows.withColumn("__salt", salt(by)).withColumn("__r", part).where(F.col("__r") <= most).drop("__salt", "__r")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= most)


def latest(rows: DataFrame, key: str, order: Sequence[Column], most: int, by: str, place: str = "place") -> DataFrame:
    """The last ``most`` rows of each ``key``, newest first by ``order`` (given newest first), with their ``place`` from 1."""
    return first_of(rows, key, order, most, by, place)
