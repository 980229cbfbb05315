"""Weights from scores, and weights under limits with the list of the limits that bound. Every tick at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickstone.functions.columns import finite, norm_symbol
from tickstone.operators.hot import first_of, with_totals

DUST = 1e-12


def faulty_symbols(rows: DataFrame, tick: str, symbol: str = "symbol") -> DataFrame:
    """``tick, symbol, problem``: blank symbols, and those given twice in a tick once they are spelled alike."""
    named = rows.select(tick, norm_symbol(symbol).alias("symbol"))
    blank = named.where("symbol is null").withColumn("problem", F.lit("blank symbol"))
    twice = named.where("symbol is not null").groupBy(tick, "symbol").count().where("count > 1").drop("count").withColumn("problem", F.lit("duplicate symbol"))
    return blank.unionByName(twice)


def weight_faults(rows: DataFrame, tick: str, symbol: str = "symbol", weight: str = "weight") -> DataFrame:
    """``tick, symbol, problem``: what ``limited`` refuses: faulty symbols, and weights that are null, NaN or infinite."""
    odd = rows.where(~finite(weight)).select(tick, norm_symbol(symbol).alias("symbol")).withColumn("problem", F.lit("weight is not finite"))
    return faulty_symbols(rows, tick, symbol).unionByName(odd)


def _checked(rows: DataFrame, tick: str, value: str, what: str) -> DataFrame:
    """``rows`` with ``symbol`` spelled alike; using ``value`` raises where a symbol is blank or repeated in its tick.

    The check is part of the plan: nothing runs before the result is asked for. One exchange, by (tick, symbol).
    """
    named = rows.withColumn("symbol", norm_symbol("symbol"))
    n = F.count("*").over(Window.partitionBy(tick, "symbol"))
    at = F.concat(F.coalesce(F.col(tick).cast("string"), F.lit("null")), F.lit(" "), F.coalesce("symbol", F.lit("")))
    fault = F.when(F.col("symbol").isNull(), F.lit("blank symbol")).when(F.col("__n") > 1, F.lit("duplicate symbol"))
    raised = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(f" in the {what} of "), at)).cast("double")).otherwise(F.col(value).cast("double"))
    return named.withColumn("__n", n).withColumn(value, raised).drop("__n")


def top_equal(scores: DataFrame, holdings: int = 25, tick: str = "tick", check: bool = True) -> DataFrame:
    """``tick, symbol, rank, weight``: the ``holdings`` highest finite scores above zero of each tick, weighted alike.

    Ties go by symbol. The weight is one over the number chosen, which may be less than ``holdings``. Blank and repeated symbols are
    refused even where their score would not be chosen (``check``): the result raises when it is asked for. A tick that holds
    most rows is ranked in parts.
    """
    if holdings < 1:
        raise ValueError("holdings must be at least 1")
    named = _checked(scores, tick, "score", "scores") if check else scores.withColumn("symbol", norm_symbol("symbol"))
    # the score of a faulty row raises in the filter
    kept = named.select(tick, "symbol", F.col("score").cast("double").alias("score")).where(finite("score") & (F.col("score") > 0))
    ranked = first_of(kept, tick, [F.desc("score"), F.asc("symbol")], holdings, "symbol")
    return ranked.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(tick))).select(tick, "symbol", "rank", "weight")


@dataclass(frozen=True)
class Limits:
    """Limits of a weighting; all finite and above zero, shares at most one."""

    max_name_weight: float = 0.05
    max_sector_weight: float = 0.30
    max_gross_weight: float = 1.0
    max_adv_fraction: float = 0.01
    target_volatility: float = 0.15
    drawdown_halt: float = 0.15

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if not math.isfinite(v) or v <= 0:
                raise ValueError(f"{f.name} must be finite and above zero")
        if max(self.max_name_weight, self.max_sector_weight, self.max_gross_weight) > 1:
            raise ValueError("weights' limits must be at most 1")


def limited(
    weights: DataFrame,
    limits: Limits = Limits(),
    tick: str = "tick",
    adv: str | None = None,
    equity: float | None = None,
    sector: str | None = None,
    current: str | None = None,
    drawdown: float = 0.0,
    volatility: float | None = None,
) -> DataFrame:
    """``weights`` (``tick, symbol, weight`` and the columns named) with ``limited`` and ``bound``, the limits that bound the row.

    In order: below zero; the name's cap; no increase over ``current`` in a drawdown; the share of ``adv`` (none known: zero); the
    sector's total; then the smaller one of the scales for the gross total and for ``volatility``. A null sector is
    ``UNKNOWN``. Symbols are spelled alike. Blank symbols, symbols repeated in a tick and weights that are null, NaN or infinite are
    refused: the result raises when it is asked for. Steps on a row stay in one projection; totals are partial sums by (tick, sector),
    joined in parts, so neither a hot tick nor a hot sector is gathered.
    """
    if not 0 <= drawdown <= 1:
        raise ValueError("drawdown must be from 0 to 1")
    if volatility is not None and not volatility > 0:
        raise ValueError("volatility must be above zero")
    if adv is not None and not (equity and equity > 0):
        raise ValueError("a share of adv needs a positive equity")
    given = _checked(weights, tick, "weight", "weights")
    odd = F.raise_error(F.concat(F.lit("weight is not finite: "), F.col("symbol"))).cast("double")
    given = given.withColumn("weight", F.when(finite("weight"), F.col("weight")).otherwise(odd))
    w = F.col("weight")
    bound: list[Column] = []

    def step(name: str, hit: Column, value: Column) -> None:
        nonlocal w
        bound.append(F.when(hit, F.lit(name)))
        w = F.when(hit, value).otherwise(w)

    step("long_only", w < 0, F.lit(0.0))
    step("max_name_weight", w > limits.max_name_weight, F.lit(limits.max_name_weight))
    if drawdown >= limits.drawdown_halt:
        held = F.greatest(F.coalesce(F.col(current), F.lit(0.0)), F.lit(0.0)) if current else F.lit(0.0)
        step("drawdown_no_new_buys", w > held, held)
    if adv is not None:
        known = finite(adv) & (F.col(adv) > 0)
        bound.append(F.when(~known & (w > 0), F.lit("missing_adv")))
        w = F.when(known, w).otherwise(F.lit(0.0))
        most = F.col(adv) * (limits.max_adv_fraction / equity)
        step("liquidity_cap", known & (w > most), most)
    group = F.coalesce(F.col(sector), F.lit("UNKNOWN")) if sector is not None else F.lit("")
    rows = given.withColumn("limited", w).withColumn("__bound", F.array_compact(F.array(*bound))).withColumn("__group", group)
    most_of = F.lit(limits.max_sector_weight if sector is not None else float("inf"))
    totals = rows.groupBy(tick, "__group").agg(F.sum("limited").alias("__total"))
    # a few rows a tick: one a sector
    totals = totals.withColumn("__gross", F.sum(F.least("__total", most_of)).over(Window.partitionBy(tick)))
    rows = with_totals(rows, totals, [tick, "__group"], "symbol")
    over = F.col("__total") > most_of
    sector_scaled = F.when(over, F.col("limited") * most_of / F.col("__total")).otherwise(F.col("limited"))
    gross_scale = F.when(F.col("__gross") > limits.max_gross_weight, F.lit(limits.max_gross_weight) / F.col("__gross")).otherwise(F.lit(1.0))
    slow = min(1.0, limits.target_volatility / volatility) if volatility is not None else 1.0
    more = F.array(F.when(over, F.lit("max_sector_weight")), F.when(gross_scale < 1, F.lit("max_gross_weight")), F.lit("volatility_target" if slow < 1 else None).cast("string"))
    out = {"limited": sector_scaled * F.least(gross_scale, F.lit(slow)), "bound": F.array_sort(F.concat("__bound", F.array_compact(more)))}
    return rows.withColumns(out).drop("__bound", "__group", "__total", "__gross")


def decision(limited_rows: DataFrame, tick: str = "tick") -> DataFrame:
    """``tick, gross, constraints``: the total of the weights that are left, and the sorted limits that bound any row of the tick."""
    kept = F.when(F.col("limited") > DUST, F.col("limited")).otherwise(F.lit(0.0))
    return limited_rows.groupBy(tick).agg(F.sum(kept).alias("gross"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("bound")))).alias("constraints"))
