"""Streams: late-safe keyed appends, features over a bounded buffer a symbol, and the visibility rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickstone.operators.simulation import after_session
from tickstone.schemas import PIT_BAR, struct
from tickstone.sources.pit_store import PitStore

BUFFER_STATE = "session array<bigint>, close array<double>, ret array<double>"
LIVE = "symbol string, session_us bigint, close double, ret_1 double, ret_5 double, vol_20 double, late boolean"
EQUITY = "event_time timestamp, gross_return double, transaction_costs double, turnover double, net_return double, equity double"


def bar_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of point-in-time bars as they land in ``folder``."""
    return spark.readStream.schema(struct(PIT_BAR)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_stream(bars: DataFrame, store: PitStore, checkpoint: str, on_batch: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Append a stream to a store. The first row of a key stays, so a batch that is run again after a failure adds nothing.

    No watermark: late rows are kept, visibility is decided when reading. Ends when the files at hand are done.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        n = store.write(batch)
        if on_batch:
            on_batch(epoch, n)

    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _live(size: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, closes, rets = (list(x) for x in state.get) if state.exists else ([], [], [])
        # order inside a micro-batch is not given: bring it back; a time that was seen stays as it was
        rows = pd.concat(list(frames)).sort_values("session_us", kind="stable")
        out = []
        for t, c in zip(rows["session_us"], rows["close"], strict=True):
            if times and t <= times[-1]:
                out.append((key[0], int(t), float(c), None, None, None, True))
                continue
            ret = c / closes[-1] - 1 if closes and closes[-1] else None
            five = c / closes[-5] - 1 if len(closes) >= 5 and closes[-5] else None
            times, closes, rets = [*times, int(t)][-size:], [*closes, float(c)][-size:], [*rets, ret][-size:]
            known = pd.Series([r for r in rets[-20:] if r is not None], dtype=float)
            out.append((key[0], int(t), float(c), ret, five, float(known.std()) if len(known) >= 10 else None, False))
        state.update((times, closes, rets))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LIVE.split(", ")]).astype({"ret_1": float, "ret_5": float, "vol_20": float})

    return run


def live_features(bars: DataFrame, size: int = 390) -> DataFrame:
    """``ret_1, ret_5, vol_20`` of a stream of ``symbol, session_us, close``, from the last ``size`` (at least 20) rows of each symbol.

    A row that is no newer than the newest seen of its symbol is handed out as ``late``, without features, and changes nothing: what
    was given out cannot be mended. Otherwise the values are those of the batch features over the same rows.
    """
    if size < 20:
        raise ValueError("the buffer must hold at least 20 rows")
    return bars.groupBy("symbol").applyInPandasWithState(_live(size), LIVE, BUFFER_STATE, "append", GroupStateTimeout.NoTimeout)


def _equity(initial: float, run: str):
    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (equity,) = state.get if state.exists else (initial,)
        rows = pd.concat(list(frames)).sort_values("event_time")
        out = []
        for r in rows.itertuples(index=False):
            equity, values = after_session(equity, r.r_over, r.r_in, r.turnover, r.a, r.b)
            out.append((key[0], r.event_time, *values))
        state.update((equity,))
        yield pd.DataFrame(out, columns=[run, *(c.split()[0] for c in EQUITY.split(", "))])

    return go


def live_equity(terms: DataFrame, initial: float = 1000.0, run: str = "run") -> DataFrame:
    """``fold`` of a stream of session terms: the equity of each ``run`` is carried on from batch to batch.

    The sessions of a run must come in order of time from batch to batch; inside a batch they are put in order.
    """
    kind = terms.schema[run].dataType.simpleString()
    return terms.groupBy(run).applyInPandasWithState(_equity(float(initial), run), f"`{run}` {kind}, {EQUITY}", "equity double", "append", GroupStateTimeout.NoTimeout)
