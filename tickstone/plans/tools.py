"""Read-only tools bound to a clock: each looks up what could be known at the clock's time, as a DataFrame.

A tool is called by name with a dict of arguments; ``schemas`` describes them all as JSON schemas. Symbols are spelled alike; unknown
ones give no rows. Every call counts against a budget.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstone.functions.columns import norm_source, norm_symbol
from tickstone.operators.features import FEATURES, add_features
from tickstone.operators.hot import first_of
from tickstone.operators.weights import Limits, limited
from tickstone.plans.clock import Clock
from tickstone.sources.pit_store import visible

TEXT = {"type": "string"}
COUNT = {"type": "integer", "minimum": 1}


class OverBudget(RuntimeError):
    """A tool was called more often than its budget allows."""


@dataclass
class BoundTools:
    """Tools over ``bars`` (point-in-time bars), ``documents`` and, for ``predict``, a ``scorer`` of feature rows.

    ``documents``: ``doc_id, text, source, symbol, form, event_time, available_at``. ``scorer`` adds a column ``prediction``.
    """

    clock: Clock
    bars: DataFrame
    documents: DataFrame | None = None
    scorer: Callable[[DataFrame], DataFrame] | None = None
    limits: Limits = Limits()
    budget: int = 100
    _spent: int = field(default=0, init=False)

    def _table(self) -> dict[str, tuple[Callable[..., DataFrame], dict[str, Any]]]:
        lookback = {"lookback_days": COUNT}
        return {
            "get_features": (self.get_features, {"symbol": TEXT, "names": {"type": "array", "items": {"enum": list(FEATURES)}}}),
            "predict": (self.predict, {"symbol": TEXT}),
            "get_price_history": (self.get_price_history, {"symbol": TEXT} | lookback),
            "get_filing": (self.get_filing, {"symbol": TEXT, "form": TEXT, "n": COUNT}),
            "get_news": (self.get_news, {"symbol": TEXT, "lookback_hours": COUNT}),
            "check_risk": (self.check_risk, {"weights": {"type": "object", "additionalProperties": {"type": "number"}}}),
        }

    def schemas(self) -> list[dict[str, Any]]:
        """Name, description and arguments of each tool; all arguments are required."""
        return [
            {"name": n, "description": (f.__doc__ or "").strip(), "parameters": {"type": "object", "properties": a, "required": list(a), "additionalProperties": False}}
            for n, (f, a) in self._table().items()
        ]

    def call(self, name: str, args: Mapping[str, Any]) -> DataFrame:
        table = self._table()
        if name not in table:
            raise KeyError(f"there is no tool {name!r}")
        tool, wanted = table[name]
        if set(args) != set(wanted):
            raise TypeError(f"{name} takes {sorted(wanted)}, not {sorted(args)}")
        if self._spent >= self.budget:
            raise OverBudget(f"{self.budget} calls are spent")
        self._spent += 1
        return tool(**args)

    def _of(self, rows: DataFrame, symbol: str) -> DataFrame:
        spelled = rows.sparkSession.range(1).select(norm_symbol(F.lit(symbol))).first()[0]
        return rows.where(norm_symbol("symbol") == F.lit(spelled)).where(visible(self.clock.now()))

    def get_price_history(self, symbol: str, lookback_days: int) -> DataFrame:
        """Bars of a symbol over the last days, up to now, by time."""
        since = F.lit(self.clock.now() - timedelta(days=lookback_days))
        return self._of(self.bars, symbol).where(F.col("event_time") > since).orderBy("event_time")

    def _newest(self, symbol: str) -> DataFrame:
        made = add_features(self._of(self.bars, symbol), order="event_time")
        return made.orderBy(F.desc("event_time")).limit(1)

    def get_features(self, symbol: str, names: list[str]) -> DataFrame:
        """Features of a symbol at its newest bar."""
        return self._newest(symbol).select("symbol", "event_time", *names)

    def predict(self, symbol: str) -> DataFrame:
        """The model's score of a symbol at its newest bar; none without a model or with a feature missing."""
        rows = self._newest(symbol).dropna(subset=list(FEATURES))
        if self.scorer is None:
            return rows.select("symbol", "event_time", F.lit(None).cast("double").alias("prediction")).limit(0)
        return self.scorer(rows).select("symbol", "event_time", "prediction")

    def _texts(self, symbol: str, source: Column) -> DataFrame:
        if self.documents is None:
            raise LookupError("no documents are bound")
        return self._of(self.documents, symbol).where("text is not null").where(source)

    def get_filing(self, symbol: str, form: str, n: int) -> DataFrame:
        """The newest filings of a form, up to now."""
        kind = (norm_source("source") == "filings") & (F.upper(F.trim("form")) == form.strip().upper())
        order = [F.desc("event_time"), F.desc("doc_id")]
        rows = self._texts(symbol, kind).select(norm_symbol("symbol").alias("symbol"), "doc_id", "form", "event_time", "text")
        return first_of(rows, "symbol", order, n, "doc_id", "place")

    def get_news(self, symbol: str, lookback_hours: int) -> DataFrame:
        """News of the last hours, up to now, the newest first."""
        since = F.lit(self.clock.now() - timedelta(hours=lookback_hours))
        rows = self._texts(symbol, norm_source("source") == "newswire").where(F.col("event_time") > since)
        return rows.select(norm_symbol("symbol").alias("symbol"), "doc_id", "event_time", "text").orderBy(F.desc("event_time"), F.desc("doc_id"))

    def check_risk(self, weights: Mapping[str, float]) -> DataFrame:
        """What the limits would leave of proposed weights, and which of them bind. Changes nothing."""
        rows = self.bars.sparkSession.createDataFrame([(0, s, float(w)) for s, w in weights.items()], "tick int, symbol string, weight double")
        return limited(rows, self.limits).select("symbol", "weight", "limited", "bound")
