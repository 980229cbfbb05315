"""Implausible values in measurements: spikes, stuck runs and impossible readings.

Each source's logarithms follow a robust autoregression of their changes: the usual non-zero change (a median) is the scale
and the quadrant correlation of consecutive changes the coefficient. A block of one to three readings is an additive
outlier if it is away from what both sides predict while the sides agree; a level shift, which does not come back, is none.
Outliers found are taken out and the tests repeated until none is new. Volumes, which come back to a typical level, are an
autoregression around it: a value is an additive outlier if its residual from the clean value before it is too large, and it is
confirmed by its distance from the typical volume itself. Stuck runs and physical limits are told apart.

Series are cut into pieces of bounded length with overlapping neighbours, whatever a source's share of the rows. One pass gives
partial statistics by piece, which are joined into one row a source; a second pass applies the tests. Medians are exact: those of
a series in several pieces lie between two of its pieces' evenly spaced order statistics, and only what is there is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import finite, usable
from tickstone.operators.readings import readings
from tickstone.operators.series import pieces, segment_median, whole_groups

PRICES = ("open", "close")
FIELDS = ("close", "open", "volume", "adj_factor")
STUCK_FIELDS = ("close", "open", "volume")
# kinds of partial statistics
CHANGE = {"open": 0, "close": 1}
VOLUME_MEDIAN, VOLUME_SPREAD = 3, 4
QUADRANTS = {"open": 5, "close": 6, "volume": 7}
VOLUME_PAIRS = 8
STEPS = {"close": 10, "open": 11, "volume": 12}
REPEATS = {"close": 20, "open": 21, "volume": 22}


@dataclass(frozen=True)
class Limits:
    """``factor``: times the usual change, or the usual spread, beyond which a value is away.
    ``spread_scale``: the spread of volumes is this times the median distance from the typical (1.25 is about the mean
    distance). ``back_within``: readings within which a spike is back. ``run``: least length of a stuck run.
    ``seldom``: share of repeats, outside such runs, below which a field seldom repeats. ``piece``: readings in a piece. ``overlap``: values of a
    field, of those that its tests use, that a piece also sees on either side of it, however many others lie between.
    """

    factor: float = 10.0
    spread_scale: float = 1.25
    back_within: int = 3
    run: int = 6
    seldom: float = 0.25
    piece: int = 4096
    overlap: int = 64


def _logs(frame: pd.DataFrame, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the finite values above zero, and their logarithms."""
    v = frame[field].to_numpy(dtype=float)
    at = np.flatnonzero(np.isfinite(v) & (v > 0))
    return at, np.log(v[at])


def _runs(v: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it repeats the one before, and the length of its run of equal values."""
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (seg[1:] != seg[:-1])
    run = np.cumsum(new) - 1
    return ~new, np.bincount(run, minlength=1)[run] if len(v) else run


def _held(frame: pd.DataFrame, field: str) -> np.ndarray:
    """Places of the values that can be in a stuck run: neither null nor NaN, volumes not zero."""
    v = frame[field].to_numpy(dtype=float)
    return np.flatnonzero(~np.isnan(v) & ((v != 0) | (field != "volume")))


def _statistics(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, seg in whole_groups(batches, ["symbol", "piece"]):
            core = frame["core"].to_numpy(dtype=bool)
            firsts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            single = frame["total"].to_numpy()[firsts] <= limits.piece
            names = frame["symbol"].to_numpy()[firsts]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            held: list[tuple[int, int, bytes]] = []

            def middle_of(kind: int, s: np.ndarray, v: np.ndarray, out=out, held=held, single=single) -> tuple[np.ndarray, np.ndarray]:
                """The median itself of a series in one piece, which is returned too; else the piece's values in order."""
                mine = single[s]
                g, m = segment_median(v[mine], s[mine])
                out.append((g, np.full(len(g), kind), m, np.bincount(s[mine], minlength=len(single))[g]))
                held.extend((int(k), kind, np.sort(v[s == k]).tobytes()) for k in np.unique(s[~mine]))
                return g, m

            def summed(kind: int, s: np.ndarray, x: np.ndarray, out=out) -> None:
                n = np.bincount(s, weights=x)
                g = np.flatnonzero(n)
                out.append((g, np.full(len(g), kind), np.zeros(len(g)), n[g]))

            for f in PRICES:
                at, x = _logs(frame, f)
                d, s = np.diff(x), seg[at][1:]
                inside = (s == seg[at][:-1]) & (d != 0)
                use = inside & core[at][1:]
                middle_of(CHANGE[f], s[use], np.log(np.abs(d[use])))
                both = use[1:] & inside[:-1] & (s[1:] == s[:-1])
                agree = np.sign(d[1:]) * np.sign(d[:-1])
                summed(QUADRANTS[f], s[1:][both], agree[both])
            at, x = _logs(frame, "volume")
            d, s = np.sign(np.diff(x)), seg[at][1:]
            both = core[at][2:] & (s[1:] == s[:-1]) & (seg[at][:-2] == s[1:])
            summed(QUADRANTS["volume"], s[1:][both], (d[1:] * d[:-1])[both])
            summed(VOLUME_PAIRS, s[1:][both], np.abs(d[1:] * d[:-1])[both])
            at, x = at[core[at]], x[core[at]]
            s = seg[at]
            g, m = middle_of(VOLUME_MEDIAN, s, x)
            middle = np.zeros(len(single))
            middle[g] = m
            mine = single[s]
            middle_of(VOLUME_SPREAD, s[mine], np.abs(x[mine] - middle[s[mine]]))
            for f in STUCK_FIELDS:
                at = _held(frame, f)
                repeat, length = _runs(frame[f].to_numpy(dtype=float)[at], seg[at])
                free = core[at] & (length < limits.run)
                summed(STEPS[f], seg[at][free], np.ones(free.sum()))
                summed(REPEATS[f], seg[at][free & repeat], np.ones((free & repeat).sum()))
            g, kind, value, n = (np.concatenate(c) for c in zip(*out, strict=True))
            g = np.r_[g.astype(int), np.array([k for k, _, _ in held], int)]
            rest = np.full(len(held), np.nan)
            yield pd.DataFrame({
                "symbol": names[g], "piece": frame["piece"].to_numpy()[firsts][g], "kind": np.r_[kind, [k for _, k, _ in held]].astype("int32"), "value": np.r_[value, rest], "n": np.r_[n, rest].astype(float),
                "total": frame["total"].to_numpy()[firsts][g], "held": [None] * len(n) + [b for _, _, b in held],
            })

    return run


PARTIAL = "symbol string, piece bigint, kind int, value double, n double, total bigint, held binary"
SPACING = 64


def _summed_partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partial statistics that are numbers. Rows are chosen here, as Spark would move a filter below the exchange and make it again."""
    for b in batches:
        yield b[b["held"].isna()][["symbol", "kind", "value", "n", "total"]]


def _joined(rows: list[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame({c: np.concatenate([r[c] for r in rows]) for c in rows[0]})


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every ``SPACING``-th of a piece's values in order and its last one, each with the values since the one before."""
    for b in batches:
        out = []
        for r in b[b["held"].notna()].itertuples(index=False):
            v = np.frombuffer(r.held)
            last = np.r_[np.arange(SPACING - 1, len(v) - 1, SPACING), len(v) - 1]
            slack = np.zeros(len(last))
            slack[0] = SPACING - 1
            out.append({"symbol": np.full(len(last), r.symbol, object), "kind": np.full(len(last), r.kind, np.int32), "total": np.full(len(last), r.total), "value": v[last], "n": np.diff(np.r_[-1, last]).astype(float), "slack": slack})
        yield from _joined(out)


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A piece's values above ``lo`` and up to ``hi``, counted, and the number of those up to ``lo``."""
    for b in batches:
        out = []
        for r in b[b["held"].notna()].itertuples(index=False):
            v = np.frombuffer(r.held)
            a, z = np.searchsorted(v, [r.lo, r.hi], side="right")
            x, n = np.unique(v[a:z], return_counts=True)
            m = len(x) + 1
            out.append({"symbol": np.full(m, r.symbol, object), "kind": np.full(m, r.kind, np.int32), "total": np.full(m, r.total), "all": np.full(m, r.all), "value": np.r_[-np.inf, x], "n": np.r_[a, n].astype(float)})
        yield from _joined(out)


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distances of volumes from the typical one, in order."""
    for b in batches:
        b = b[b["held"].notna() & (b["kind"] == VOLUME_MEDIAN)]
        held = [np.sort(np.abs(np.frombuffer(h) - m)).tobytes() for h, m in zip(b["held"], b["middle"], strict=True)]
        yield b[["symbol", "piece", "kind", "value", "n", "total"]].assign(kind=np.int32(VOLUME_SPREAD), held=held)


def _by_piece(rows: DataFrame, limits: Limits) -> DataFrame:
    """Each row once for each piece of its series: joined so, no rows of a long series move together."""
    last = F.floor((F.col("total") - 1) / limits.piece)
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("total")


def _exact_medians(held: DataFrame, limits: Limits) -> DataFrame:
    """``symbol, kind, value, n, total``: the (lower) median and the number of the values that all pieces of a series hold.

    Of the values up to a point, those counted by the points up to it are known, and each piece has at most ``slack`` more. This
    gives bounds around the median; the values between them, a share of ``2 * SPACING / Limits.piece`` or so, are counted.
    """
    key = ["symbol", "kind"]
    upto, whole = Window.partitionBy(*key).orderBy("value"), Window.partitionBy(*key)
    points = held.mapInPandas(_points, "symbol string, kind int, total bigint, value double, n double, slack double")
    points = points.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"), F.sum("slack").over(whole).alias("more"))
    rank = F.ceil(F.col("all") / 2)
    bounds = points.groupBy(*key, "total", "all").agg(
        F.coalesce(F.max(F.when(F.col("upto") + F.col("more") < rank, F.col("value"))), F.lit(float("-inf"))).alias("lo"),
        F.min(F.when(F.col("upto") >= rank, F.col("value"))).alias("hi"),
    )
    # all columns of ``held`` are kept, so that its exchange is the one of the points
    near = held.join(_by_piece(bounds, limits), [*key, "piece"])
    inside = near.mapInPandas(_between, "symbol string, kind int, total bigint, all double, value double, n double")
    # equal values of several pieces are peers in the window, which counts them together
    found = inside.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= rank)
    return found.groupBy(*key, "total", "all").agg(F.min("value").alias("value")).select(*key, "value", F.col("all").alias("n"), "total")


STAT_COLUMNS = [f"u_{f}" for f in PRICES] + [f"phi_{f}" for f in (*PRICES, "volume")] + ["volume_typical", "volume_spread"] + [f"rare_{f}" for f in STUCK_FIELDS]


def _join_statistics(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, seg in whole_groups(batches, ["symbol"]):
            kind, value, n = (frame[c].to_numpy() for c in ("kind", "value", "n"))
            firsts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            rows = len(firsts)
            out = pd.DataFrame({"symbol": frame["symbol"].to_numpy()[firsts], "total": frame["total"].to_numpy()[firsts]})

            def median(k: int, kind=kind, value=value, seg=seg, rows=rows) -> np.ndarray:
                r = np.full(rows, np.nan)
                r[seg[kind == k]] = value[kind == k]
                return r

            def total(k: int, kind=kind, n=n, seg=seg, rows=rows) -> np.ndarray:
                return np.bincount(seg[kind == k], weights=n[kind == k], minlength=rows)

            for f in PRICES:
                out[f"u_{f}"] = np.exp(median(CHANGE[f]))
                changes = np.maximum(total(CHANGE[f]), 1)
                out[f"phi_{f}"] = np.clip(np.sin(np.pi / 2 * np.clip(total(QUADRANTS[f]) / changes, -1, 1)), -0.5, 0.5)
            # changes of an autoregression with coefficient phi around a level correlate by -(1 - phi) / 2
            turns = np.sin(np.pi / 2 * np.clip(total(QUADRANTS["volume"]) / np.maximum(total(VOLUME_PAIRS), 1), -1, 1))
            out["phi_volume"] = np.clip(1 + 2 * turns, 0.0, 0.5)
            out["volume_typical"] = median(VOLUME_MEDIAN)
            out["volume_spread"] = median(VOLUME_SPREAD) * limits.spread_scale
            for f in STUCK_FIELDS:
                out[f"rare_{f}"] = (total(REPEATS[f]) / np.maximum(total(STEPS[f]), 1) < limits.seldom).astype(float)
            yield out

    return run


def additive_outliers(x: np.ndarray, seg: np.ndarray, scale: np.ndarray, phi: np.ndarray, factor: float, longest: int = 3) -> np.ndarray:
    """Marks of additive outliers in logarithms ``x`` of sorted series; ``scale`` and ``phi`` are given for each value.

    A block of at most ``longest`` values is marked if each is more than ``factor * scale`` away from what the clean values
    before predict, from what those after predict and from the median of the values around, while the
    values next to it on both sides are within that distance of one another. Where they are not, the level has
    shifted and nothing is marked.
    """
    out = np.zeros(len(x), bool)
    again = True
    while again:
        again = False
        for m in range(1, longest + 1):
            k = np.flatnonzero(~out)
            if len(k) < m + 2:
                continue
            v, s, far = x[k], seg[k], factor * scale[k]
            step = np.clip(np.r_[0.0, np.where(s[1:] == s[:-1], np.diff(v), 0.0)], -3 * scale[k], 3 * scale[k])
            ahead = v + phi[k] * step
            back = v - phi[k] * np.r_[step[1:], 0.0]
            p = np.arange(len(k) - m - 1)
            q = p + m + 1
            with np.errstate(invalid="ignore"):
                hit = (s[p] == s[q]) & (np.abs(v[q] - v[p]) <= far[p])
                for j in range(1, m + 1):
                    hit &= (np.abs(v[p + j] - ahead[p]) > far[p]) & (np.abs(v[p + j] - back[q]) > far[p])
            for a in np.flatnonzero(hit):
                b = a + m + 1
                near = np.r_[max(0, a - 4) : a + 1, b : min(len(k), b + 5)]
                level = np.median(v[near[s[near] == s[a]]])
                if np.all(np.abs(v[a + 1 : b] - level) > far[a]):
                    out[k[a + 1 : b]] = True
                    again = True
    return out


def departures(d: np.ndarray, seg: np.ndarray, far: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Marks of additive outliers in departures ``d`` from a typical level, an autoregression with coefficient ``phi`` (0 to 1).

    A value's residual from the clean value before it is tested against what a departure of ``far`` leaves at least, ``(1 - phi) * far``; those
    found are confirmed by the departure itself, taken out, and the tests repeated. As the value before the first outlier that is
    left is within ``far``, every departure beyond ``far`` is found in the end.
    """
    out = np.zeros(len(d), bool)
    while True:
        k = np.flatnonzero(~out)
        v, s = d[k], seg[k]
        before = np.r_[0.0, np.where(s[1:] == s[:-1], v[:-1], 0.0)][: len(k)]
        with np.errstate(invalid="ignore"):
            hit = (np.abs(v - phi[k] * before) > (1 - phi[k]) * far[k] * (1 - 1e-12)) & (np.abs(v) > far[k])
        if not hit.any():
            return out
        out[k[hit]] = True


def _tests(limits: Limits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, seg in whole_groups(batches, ["symbol", "piece"]):
            core = frame["core"].to_numpy(dtype=bool)
            stat = {c: frame[c].to_numpy(dtype=float) for c in STAT_COLUMNS}
            for f in FIELDS:
                v = frame[f].to_numpy(dtype=float)
                marks = {k: np.zeros(len(v), bool) for k in ("limit", "spike", "stuck")}
                with np.errstate(invalid="ignore"):
                    marks["limit"] = (v < 0) | np.isinf(v) | ((v == 0) & (f != "volume"))
                at, x = _logs(frame, f)
                if f == "volume":
                    spread, phi = stat["volume_spread"][at], np.nan_to_num(stat["phi_volume"][at])
                    far = np.where(spread > 0, limits.factor * spread, np.inf)
                    marks["spike"][at] = departures(np.nan_to_num(x - stat["volume_typical"][at]), seg[at], far, phi)
                elif f == "adj_factor":
                    tiny = np.full(len(at), 1e-9 / limits.factor)
                    marks["spike"][at] = additive_outliers(x, seg[at], tiny, np.zeros(len(at)), limits.factor, limits.back_within)
                else:
                    u = stat[f"u_{f}"][at]
                    u = np.where(np.isfinite(u), u, np.inf)
                    marks["spike"][at] = additive_outliers(x, seg[at], np.minimum(u, 1e300), stat[f"phi_{f}"][at], limits.factor, limits.back_within)
                if f in STUCK_FIELDS:
                    at = _held(frame, f)
                    repeat, length = _runs(v[at], seg[at])
                    marks["stuck"][at] = repeat & (length >= limits.run) & (stat[f"rare_{f}"][at] > 0)
                kind = np.select(list(marks.values()), list(marks), "")
                found = np.flatnonzero(core & (kind != ""))
                if len(found):
                    yield pd.DataFrame({"symbol": frame["symbol"].to_numpy()[found], "event_us": frame["pos_us"].to_numpy()[found], "field": f, "kind": kind[found], "value": v[found]})

    return run


def needed_values() -> dict[str, Column]:
    """The values of each field that its tests use: those with a logarithm, and those that can be in a stuck run."""
    held = {f"held_{f}": usable(f) & ((F.col(f) != 0) | F.lit(f != "volume")) for f in STUCK_FIELDS}
    return {f"log_{f}": finite(f) & (F.col(f) > 0) for f in FIELDS} | held


def series_statistics(parts: DataFrame, limits: Limits) -> DataFrame:
    """One row a series with what the tests need: ``symbol, total`` and ``STAT_COLUMNS``."""
    by_piece = ["symbol", "piece", "pos"]
    # every use reads all columns and knows the keys to be there, so that Spark makes each exchange once
    keyed = "symbol is not null and kind is not null and piece is not null"
    partial = parts.sortWithinPartitions(*by_piece).mapInPandas(_statistics(limits), PARTIAL).where(keyed).repartition("symbol", "kind", "piece")
    medians = _exact_medians(partial, limits)
    # all kinds, of which _distances takes the volume's: a filter here would pass through the join below the exchange of ``partial``
    typical = _by_piece(medians.select("symbol", "kind", F.col("value").alias("middle"), "total"), limits)
    away = partial.join(typical, ["symbol", "kind", "piece"]).mapInPandas(_distances, PARTIAL).where(keyed).repartition("symbol", "kind", "piece")
    summed = partial.mapInPandas(_summed_partials, "symbol string, kind int, value double, n double, total bigint")
    summed = summed.groupBy("symbol", "kind", "value", "total").agg(F.sum("n").alias("n")).select("symbol", "kind", "value", "n", "total")
    every = summed.unionByName(medians).unionByName(_exact_medians(away, limits))
    schema = "symbol string, total bigint, " + ", ".join(f"{c} double" for c in STAT_COLUMNS)
    return every.repartition("symbol").sortWithinPartitions("symbol", "kind", "value").mapInPandas(_join_statistics(limits), schema)


def implausible(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``symbol, event_us, field, kind, value``: one row for each implausible value of a reading.

    ``kind`` is ``limit`` (negative, infinite, or zero but for a volume), else ``spike``, else ``stuck`` (repeats the value before
    in a run of ``limits.run`` or more, of a field that seldom repeats). Null and NaN values are no cases and are passed
    over by the tests; zero volumes are no cases. A field whose every change is zero has no spikes; a symbol with
    fewer than three readings has only ``limit`` cases. Rows without symbol or time are dropped, repeated deliveries
    count once, empty tables give no rows, extra columns are ignored.
    """
    r = readings(bars, FIELDS).withColumn("pos_us", F.unix_micros("event_time")).drop("event_time")
    parts = pieces(r, "symbol", "day", "pos_us", limits.piece, limits.overlap, needed_values())
    by_piece = ["symbol", "piece", "pos"]
    stats = _by_piece(series_statistics(parts, limits), limits)
    # both passes read every column of the pieces, so that Spark makes their exchange once
    # from the left: a series without statistics still has its limit cases and those of adj_factor
    tested = parts.join(stats, ["symbol", "piece"], "left").sortWithinPartitions(*by_piece)
    return tested.mapInPandas(_tests(limits), "symbol string, event_us bigint, field string, kind string, value double")


def outlier_report(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``symbol, field, kind, n, first_us, last_us``: the implausible values counted by symbol, field and kind."""
    return (
        implausible(bars, limits)
        .groupBy("symbol", "field", "kind")
        .agg(F.count("*").alias("n"), F.min("event_us").alias("first_us"), F.max("event_us").alias("last_us"))
    )
