"""A daily simulation as parallel terms by session and a small fold in time.

Holdings after a session follow from its targets and prices alone, so all returns, the turnover and the two cost terms of a
session are windows and sums over all sessions at once. Only the money depends on the past: with ``e`` before trading the cost is
``a * e + b * e ** 1.5``. The fold over one row a session applies that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tickstone.functions.columns import finite, norm_symbol
from tickstone.operators.series import bucket_of, in_pieces
from tickstone.session import small

NEEDED = ("symbol", "event_time", "open", "close", "target_weight", "signal_available_at", "adv_dollars", "annual_volatility")
RESULT = "event_time timestamp, gross_return double, transaction_costs double, turnover double, net_return double, equity double"


@dataclass(frozen=True)
class CostModel:
    """A linear part in basis points and an impact that grows as the root of the share of daily volume."""

    commission_bps: float = 0.0
    half_spread_bps: float = 2.5
    impact: float = 0.1

    def __post_init__(self) -> None:
        if any(not math.isfinite(v) or v < 0 for v in (self.commission_bps, self.half_spread_bps, self.impact)):
            raise ValueError("cost parameters must be finite and not negative")

    @property
    def linear(self) -> float:
        return (self.commission_bps + self.half_spread_bps) / 10_000

    def rate(self, notional: Column, adv: Column, volatility: Column) -> Column:
        """Cost as a share of the order; null for an ``adv`` of zero."""
        return F.lit(self.linear) + F.lit(self.impact) * volatility * F.sqrt(F.try_divide(notional, adv))

    def dollars(self, notional: Column, adv: Column, volatility: Column) -> Column:
        return notional * self.rate(notional, adv, volatility)


def _named(panel: DataFrame) -> DataFrame:
    lacking = sorted(set(NEEDED) - set(panel.columns))
    if lacking:
        raise ValueError(f"the panel lacks columns: {lacking}")
    numbers = {c: F.col(c).cast("double") for c in ("open", "close", "target_weight", "adv_dollars", "annual_volatility")}
    return panel.select(*NEEDED).withColumn("symbol", norm_symbol("symbol")).withColumns(numbers)


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key`` and ``n`` of the keys with several rows; a null in a key is a value."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def violations(panel: DataFrame, opens: DataFrame | None = None) -> DataFrame:
    """``event_time, phase, symbol, problem``: everything in a panel that a simulation must refuse.

    ``opens`` (``session_date, open_utc``) is the calendar: an ``event_time`` on a (UTC) date that is no session, and signals known only after
    the session's open are then violations. Phase 1 are rows, 2 sessions, 3 holdings without a bar in the next session.
    """
    p = _named(panel)
    late = F.lit(False)
    off = F.lit(False)
    if opens is not None:
        days = small(opens.select(F.col("session_date").cast("date").alias("__day"), "open_utc").dropDuplicates(["__day"]), 100_000)
        p = p.withColumn("__day", F.to_date("event_time")).join(days, "__day", "left")
        late, off = F.col("signal_available_at") > F.col("open_utc"), F.col("open_utc").isNull()
    checks = [
        (off, "date is no session"),
        (F.col("symbol").isNull(), "blank symbol"),
        (~(finite("open") & finite("close") & finite("target_weight")) | (F.col("open") <= 0) | (F.col("close") <= 0), "invalid price or target"),
        (F.col("target_weight") < 0, "negative target"),
        (F.coalesce(late, F.lit(True)) if opens is not None else late, "signal after the open"),
        (~finite("adv_dollars") | (F.col("adv_dollars") <= 0), "invalid adv_dollars"),
        (~finite("annual_volatility") | (F.col("annual_volatility") < 0), "invalid annual_volatility"),
    ]
    problem = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in checks))
    rows = p.select("event_time", F.lit(1).alias("phase"), "symbol", problem.alias("problem")).where("problem is not null")
    twice = repeated(p, ["event_time", "symbol"]).select("event_time", F.lit(1).alias("phase"), "symbol", F.lit("duplicate symbol").alias("problem"))
    gross = p.groupBy("event_time").agg(F.sum("target_weight").alias("g")).where("g > 1 + 1e-9").select("event_time", F.lit(2).alias("phase"), F.lit(None).cast("string").alias("symbol"), F.lit("targets above 100%").alias("problem"))
    return rows.unionByName(twice).unionByName(gross).unionByName(missing_next(p))


def _next_times(times: DataFrame, at: str) -> DataFrame:
    """Each distinct time with the ``next`` one: inside its bucket of 32 days, else the first of the next bucket that has one.

    Only the buckets (a dozen a year) are ordered in one task.
    """
    distinct = times.select(at).where(F.col(at).isNotNull()).distinct().withColumn("__b", bucket_of(times, at))
    later = distinct.groupBy("__b").agg(F.min(at).alias("__first")).withColumn("__later", F.lead("__first").over(Window.partitionBy(F.lit(0)).orderBy("__b")))
    inside = distinct.withColumn("next", F.lead(at).over(Window.partitionBy("__b").orderBy(at)))
    return inside.join(later.select("__b", "__later"), "__b").select(at, F.coalesce("next", "__later").alias("next"))


def missing_next(panel: DataFrame) -> DataFrame:
    """Symbols held after a session that have no bar in the next one, at the later session's time."""
    times = _next_times(panel, "event_time")
    held = panel.where("target_weight > 0").select("event_time", "symbol").join(times, "event_time").where("next is not null")
    gone = held.select(F.col("next").alias("event_time"), "symbol").join(panel.select("event_time", "symbol"), ["event_time", "symbol"], "left_anti")
    return gone.select("event_time", F.lit(3).alias("phase"), "symbol", F.lit("held symbol has no bar").alias("problem"))


def session_terms(panel: DataFrame, cost: CostModel = CostModel(), run: str | None = None) -> DataFrame:
    """One row a session: ``r_over`` (before the open, on what is held), ``r_in`` (from open to close), ``turnover``, ``a``, ``b``.

    ``run`` names a column that keeps several simulations apart. Rows without symbol or session are left out. A symbol's series is
    worked on in pieces; a session's totals are partial sums, joined back to its rows (one row a session: broadcast where Spark
    finds it small, split where a session is hot).
    """
    keys = [*([run] if run else []), "event_time"]
    series = F.to_json(F.struct(F.col(run).alias("run"), "symbol")) if run else F.col("symbol")
    base = panel.withColumn("symbol", norm_symbol("symbol")).where("symbol is not null").withColumn("__series", series)
    base = base.withColumn("__grow", F.col("target_weight") * F.try_divide(F.col("close"), F.col("open")))
    inside = base.groupBy(*keys).agg(F.sum(F.col("__grow") - F.col("target_weight")).alias("r_in"))

    def made(rows: DataFrame, w: WindowSpec) -> DataFrame:
        held = F.when(F.lag("target_weight").over(w) > 0, F.lag("__grow").over(w))
        return rows.withColumns({"__held": held, "__then": F.lag("event_time").over(w), "__gap": F.coalesce(F.try_divide(F.col("open"), F.lag("close").over(w)), F.lit(1.0))})

    rows = in_pieces(base, "__series", "event_time", 1, made)
    then = inside.select(*keys[:-1], F.col("event_time").alias("__then"), F.col("r_in").alias("__r_then"))
    rows = rows.join(then, [*keys[:-1], "__then"], "left").withColumn("__was", F.coalesce(F.try_divide(F.col("__held"), 1 + F.col("__r_then")), F.lit(0.0)))
    over = rows.groupBy(*keys).agg(F.sum(F.col("__was") * (F.col("__gap") - 1)).alias("r_over"))
    moved = F.abs(F.col("target_weight") - F.try_divide(F.col("__was") * F.col("__gap"), 1 + F.col("r_over")))
    terms = rows.join(over, keys).withColumn("__d", moved)
    sums = terms.groupBy(*keys).agg(
        F.first("r_over").alias("r_over"),
        F.sum("__d").alias("turnover"),
        (F.lit(cost.linear) * F.sum("__d")).alias("a"),
        F.sum(F.lit(cost.impact) * F.col("annual_volatility") * F.pow(F.col("__d"), F.lit(1.5)) / F.sqrt("adv_dollars")).alias("b"),
    )
    return sums.join(inside, keys).select(*keys, "r_over", "r_in", "turnover", "a", "b")


def after_session(equity: float, r_over: float, r_in: float, turnover: float, a: float, b: float) -> tuple[float, tuple[float, float, float, float, float]]:
    """The equity after a session, and the session's gross return, costs, turnover, net return and equity. NaN once it is not above zero."""
    before = equity * (1 + r_over)
    before = before if before > 0 else math.nan
    paid = a * before + b * before**1.5
    left = before - paid if before - paid > 0 else math.nan
    after = left * (1 + r_in)
    after = after if after > 0 else math.nan
    return after, (before * (1 + r_in) / equity - 1, paid, turnover, after / equity - 1, after)


def _folded(initial: float, run: str | None):
    names = [*([run] if run else []), "event_time", "gross_return", "transaction_costs", "turnover", "net_return", "equity"]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        equity, at = initial, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if run and r[0] != at:
                    equity, at = initial, r[0]
                equity, values = after_session(equity, *r[-5:])
                out.append((*r[:-5], *values))
            yield pd.DataFrame(out, columns=names)

    return go


def fold(terms: DataFrame, initial: float = 1000.0, run: str | None = None) -> DataFrame:
    """``event_time, gross_return, transaction_costs, turnover, net_return, equity`` from ``session_terms``.

    One pass over the sessions of each run in order, one row a session, that holds the equity only; runs are spread over tasks. Equity that
    is not above zero makes this and all later sessions' values null, which ``simulate`` refuses.
    """
    if not math.isfinite(initial) or initial <= 0:
        raise ValueError("the initial equity must be finite and above zero")
    keys = [run] if run else []
    columns = [*keys, "event_time", "r_over", "r_in", "turnover", "a", "b"]
    kinds = {f.name: f.dataType.simpleString() for f in terms.schema}
    given = terms.select(*columns)
    laid = given.repartition(run) if run else given.repartition(1)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, "event_time"]), *(f"{c} double" for c in ("gross_return", "transaction_costs", "turnover", "net_return", "equity"))])
    out = laid.sortWithinPartitions(*keys, "event_time").mapInPandas(_folded(float(initial), run), schema)
    numbers = ("gross_return", "transaction_costs", "turnover", "net_return", "equity")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in numbers})


def simulate(panel: DataFrame, initial: float = 1000.0, cost: CostModel = CostModel(), opens: DataFrame | None = None) -> DataFrame:
    """The simulation of a checked panel, by event_time; an empty panel gives the same columns and no rows.

    Every violation is looked for first; the earliest by (event_time, phase, symbol) is raised as ``ValueError``.
    """
    first = violations(panel, opens).orderBy("event_time", "phase", "symbol").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].problem}: {first[0].symbol or ''} at {first[0].event_time}")
    out = fold(session_terms(panel, cost), initial)
    broke = out.where("equity is null").orderBy("event_time").limit(1).collect()
    if broke:
        raise ValueError(f"equity is not above zero at {broke[0].event_time}")
    return out.orderBy("event_time")
