"""A research run as a flow: bars as of a time, features, a model, its evaluation and run card."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstone.operators.evaluation import metrics, predict, split, train_baseline
from tickstone.operators.features import FEATURES, add_features, usable_labels
from tickstone.plans.clock import Tick
from tickstone.plans.flow import Context, Flow, Message, Missing, Node, frame_digest
from tickstone.sources.files import BarSource, CsvBars, synthetic_bars, write_card, write_csv

AS_OF = datetime(2023, 6, 30, 23, 59, tzinfo=UTC)
TRAIN_END = datetime(2022, 12, 30, 23, 59, tzinfo=UTC)
EVAL_START = date(2023, 1, 3)


@dataclass(frozen=True)
class Bars(Message):
    frame: DataFrame
    excluded: int


@dataclass(frozen=True)
class Features(Message):
    frame: DataFrame


@dataclass(frozen=True)
class Model(Message):
    trees: Any = field(repr=False)
    train_rows: int


@dataclass(frozen=True)
class Evaluation(Message):
    values: dict[str, float]


class LoadBars(Node):
    """The bars that the source shows at the tick."""

    name, writes = "LoadBars", Bars

    def __init__(self, source: BarSource):
        super().__init__()
        self.source = source

    def run(self, ctx: Context) -> Bars:
        frame, hidden = self.source.load_as_of(ctx.clock.now())
        return Bars(ctx.tick, self.name, frame, hidden)


class BuildFeatures(Node):
    name, reads, writes = "BuildFeatures", (Bars,), Features

    def run(self, ctx: Context) -> Features:
        frame = usable_labels(add_features(ctx.inputs[Bars].frame), F.lit(ctx.clock.now()))
        return Features(ctx.tick, self.name, frame)


def _parts(frame: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    return split(frame, F.lit(TRAIN_END), F.lit(EVAL_START), F.lit(now))


class _Trees:
    """A fitted model that is digested by its text, which names every split."""

    def __init__(self, fitted: Any):
        self.fitted = fitted

    def digest_value(self) -> str:
        return self.fitted.toDebugString.split("\n", 1)[-1]


class TrainBaseline(Node):
    name, reads, writes = "TrainBaseline", (Features,), Model

    def __init__(self, iterations: int = 80):
        super().__init__()
        self.iterations = iterations

    def run(self, ctx: Context) -> Model:
        train, _ = _parts(ctx.inputs[Features].frame, ctx.clock.now())
        return Model(ctx.tick, self.name, _Trees(train_baseline(train, iterations=self.iterations)), train.count())


class EvaluateBaseline(Node):
    """Metrics of the held-out rows, also written as a run card."""

    name, reads, writes = "EvaluateBaseline", (Bars, Features, Model), Evaluation

    def __init__(self, card: Path | None = None):
        super().__init__()
        self.card = card

    def run(self, ctx: Context) -> Evaluation:
        bars, features, model = (ctx.inputs[x] for x in self.reads)
        _, held = _parts(features.frame, ctx.clock.now())
        got = metrics(predict(model.trees.fitted, held)).first()
        if not got.n:
            raise ValueError("no evaluation rows")
        values = {"eval_rows": got.n, "train_rows": model.train_rows, "rmse": got.rmse, "zero_rmse": got.zero_rmse, "correlation": got.correlation}
        if self.card:
            fitted = model.trees.fitted
            card = {
                "run_id": ctx.run_id,
                "data": {"sha256": frame_digest(bars.frame), "as_of": ctx.tick.at.isoformat(), "visible_rows": bars.frame.count(), "excluded_rows": bars.excluded, "feature_rows": features.frame.count()},
                "split": {"train_end": TRAIN_END.isoformat(), "eval_start": EVAL_START.isoformat(), "label_available_by": ctx.tick.at.isoformat()},
                "model": {"class": type(fitted).__qualname__, "parameters": {p.name: v for p, v in fitted.extractParamMap().items()}, "features": list(FEATURES), "trees": fitted.getNumTrees},
                "metrics": values,
            }
            write_card(self.card, card)
        return Evaluation(ctx.tick, self.name, values)


def research_flow(spark: SparkSession, source: BarSource, card: Path | None = None, iterations: int = 80) -> Flow:
    return Flow([LoadBars(source), BuildFeatures(), TrainBaseline(iterations), EvaluateBaseline(card)], spark=spark)


def run_demo(spark: SparkSession, folder: Path, run_id: str = "demo", iterations: int = 80) -> dict[type, Message | Missing]:
    """Write synthetic bars below ``folder``, run the flow as of ``AS_OF``, leave an event log and a run card there."""
    shown = synthetic_bars(spark).select("symbol", F.col("session").cast("string").alias("session"), F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("available_at"), "close")
    write_csv(shown, str(folder / "bars"))
    flow = research_flow(spark, CsvBars(spark, str(folder / "bars")), folder / "card.json", iterations)
    return flow.run(Tick.from_datetime(AS_OF), run_id, folder / "events.jsonl")
