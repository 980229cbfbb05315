"""Long series in bounded pieces: exact positions, pieces of a fixed number of readings, overlapping neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def pieces(rows: DataFrame, key: str, bucket: str, order: str, size: int, overlap: int, usable: Mapping[str, Column] | None = None, mark: str = "") -> DataFrame:
    """Cut each key's rows, in ``order``, into pieces of ``size`` rows that also hold the rows around them.

    A piece also holds the ``overlap`` rows before and after it. With conditions in ``usable`` it holds, for each of them, at least the
    ``overlap`` rows before and after it that meet it, however far away they are, or all there are; rows that meet none are not repeated.
    Adds ``piece`` (from 0), ``core`` (false for a neighbour's row), ``pos`` (place in the whole series) and
    ``total`` (length of the series), each with ``mark`` before its name. ``rows`` must be unique by (key, order), laid out by (key, ``bucket``), and
    ``bucket`` must not decrease with ``order``. Places are exact: the counts of the buckets before, plus the place
    inside the bucket. So no task ever holds more than a bucket or a piece of a key, however long its series is; one row a
    bucket is gathered by key. The result is laid out by (key, piece), unsorted.
    """
    if size < 2 * overlap:
        raise ValueError("size must be at least twice the overlap")
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(key, bucket).schema}
    conditions = dict(usable or {})
    counts = rows.groupBy(key, bucket).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"__u_{u}") for u, c in conditions.items()))
    if conditions:
        columns = [f"`{key}` {kinds[key]}", f"`{bucket}` {kinds[bucket]}", "__before bigint", f"{mark}total bigint", *(f"__lo_{u} bigint, __hi_{u} bigint" for u in conditions)]
        laid = counts.repartition(key).sortWithinPartitions(key, bucket)
        placing = laid.mapInPandas(_reaches(key, bucket, size, overlap, list(conditions), f"{mark}total"), ", ".join(columns))
    else:
        whole = Window.partitionBy(key)
        before = F.sum("n").over(whole.orderBy(bucket)) - F.col("n")
        placing = counts.select(key, bucket, before.alias("__before"), F.sum("n").over(whole).alias(f"{mark}total"))
    placed = rows.withColumn("__in", F.row_number().over(Window.partitionBy(key, bucket).orderBy(order))).join(placing, [key, bucket])
    pos = F.col("__before") + F.col("__in") - 1
    own = F.floor(pos / size)
    if conditions:
        # a row that meets a condition goes to the pieces that need it for that condition
        lo = F.least(own, *(F.when(c, F.col(f"__lo_{u}")).otherwise(own) for u, c in conditions.items()))
        hi = F.greatest(own, *(F.when(c, F.col(f"__hi_{u}")).otherwise(own) for u, c in conditions.items()))
    else:
        at = pos % size
        lo = F.when((at < overlap) & (own > 0), own - 1).otherwise(own)
        hi = F.when((at >= size - overlap) & ((own + 1) * size < F.col(f"{mark}total")), own + 1).otherwise(own)
    out = placed.withColumns({f"{mark}pos": pos, "__own": own, "__lo": lo, "__hi": hi}).withColumn(f"{mark}piece", F.explode(F.sequence("__lo", "__hi")))
    made = [c for u in conditions for c in (f"__lo_{u}", f"__hi_{u}")]
    out = out.withColumn(f"{mark}core", F.col(f"{mark}piece") == F.col("__own")).drop("__before", "__in", "__own", "__lo", "__hi", bucket, *made)
    return out.repartition(key, f"{mark}piece")


def _reaches(key: str, bucket: str, size: int, overlap: int, usable: Sequence[str], total_name: str):
    """For each bucket the rows before it and in the series, and for each condition the first and last piece that need its rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, seg in whole_groups(batches, [key]):
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            last = np.append(first[1:], len(seg)) - 1

            def running(x: np.ndarray, seg: np.ndarray = seg, first: np.ndarray = first) -> np.ndarray:
                through = np.cumsum(x)
                return through - (through[first] - x[first])[seg]

            n = frame["n"].to_numpy()
            through = running(n)
            before, total = through - n, through[last][seg]
            out = {key: frame[key], bucket: frame[bucket], "__before": before, total_name: total}
            base = seg * (2 * int(total.max()) + 2)
            for u in usable:
                count = frame[f"__u_{u}"].to_numpy()
                upto = running(count)
                at = base + upto
                # pieces that begin before the end of the first bucket with enough others in between
                ahead = np.minimum(np.searchsorted(at, at + overlap - 1, side="right"), last[seg])
                # and those that end after the beginning of the last such bucket before it
                back = np.searchsorted(at, base + np.maximum(upto - count - overlap, -1), side="right")
                out |= {f"__lo_{u}": before[back] // size, f"__hi_{u}": (through[ahead] - 1) // size}
            yield pd.DataFrame(out)

    return run


def bucket_of(rows: DataFrame, order: str) -> Column:
    """Buckets along ``order`` (a date, a time or a number) for ``pieces``: 32 days, or 1,024 units of a number."""
    kind, c = rows.schema[order].dataType.typeName(), F.col(order)
    if kind == "date":
        units = F.floor(F.unix_date(c) / 32)
    elif kind in ("timestamp", "timestamp_ntz"):
        units = F.floor(F.unix_date(c.cast("date")) / 32)
    else:
        units = F.floor(c.cast("double") / 1024)
    return units.cast("bigint")


def in_pieces(rows: DataFrame, key: str, order: str, reach: int, made: Callable[[DataFrame, WindowSpec], DataFrame], size: int = 4096) -> DataFrame:
    """``made`` (a frame and a window by series) of ``rows``, series by series, each in pieces: a hot key is worked on by many tasks.

    Columns that ``made`` adds may look at ``reach`` rows of a series to either side. Rows without ``key`` or ``order`` belong to no
    series and are left out; of rows at one place in a series the order is not defined.
    """
    there = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("__bucket", bucket_of(rows, order))
    cut = pieces(there, key, "__bucket", order, max(size, 2 * reach), reach, mark="__")
    done = made(cut, Window.partitionBy(key, "__piece").orderBy("__pos"))
    return done.where("__core").drop("__piece", "__core", "__pos", "__total")


def carried(rows: DataFrame, key: str, order: str, name: str, value: Column, total: Callable[[Column], Column], join: Callable[..., Column]) -> DataFrame:
    """``rows`` with ``name``: ``total`` (such as ``F.max``) of ``value`` over a series up to each row, joined by ``join`` (``F.greatest``) over buckets.

    Each bucket of a series is worked on by itself; what came before it is one row a bucket. Rows without ``key`` or ``order`` are left out.
    """
    there = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumns({"__bucket": bucket_of(rows, order), "__value": value})
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = there.groupBy(key, "__bucket").agg(total("__value").alias("__t")).select(key, "__bucket", total("__t").over(before).alias("__before"))
    upto = Window.partitionBy(key, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = there.withColumn("__upto", total("__value").over(upto)).join(buckets, [key, "__bucket"])
    return out.withColumn(name, join("__upto", "__before")).select(*rows.columns, name)


def whole_groups(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups, with each row's group number, from batches sorted by ``keys``.

    Holds back the last group of a batch until it is complete; a group must be of bounded size.
    """
    held: pd.DataFrame | None = None
    for b in batches:
        if not len(b):
            continue
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        new = _starts(b, keys)
        last = np.flatnonzero(new)[-1]
        held = b.iloc[last:]
        if last:
            yield b.iloc[:last], np.cumsum(new[:last]) - 1
    if held is not None:
        yield held.reset_index(drop=True), np.zeros(len(held), int)


def _starts(b: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    new = np.zeros(len(b), bool)
    new[0] = True
    for k in keys:
        v = b[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def segment_median(values: np.ndarray, seg: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the segments that have values, and their (lower, weighted) medians."""
    if not len(values):
        return np.zeros(0, int), np.zeros(0)
    order = np.lexsort((values, seg))
    v, s = values[order], seg[order]
    w = np.ones(len(v)) if weights is None else weights[order].astype(float)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    upto = np.cumsum(w)
    before = np.r_[0.0, upto[first[1:] - 1]]
    half = before + (upto[np.r_[first[1:], len(s)] - 1] - before) / 2
    middle = np.searchsorted(upto, half - 1e-9)
    middle = np.clip(middle, first, first + size - 1)
    return s[first], v[middle]
