from __future__ import annotations

import json
import time
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

import pytest
from helpers import bar, frame, tuples
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstone.operators.features import add_features
from tickstone.plans.clock import Clock, Tick, Timeline
from tickstone.plans.flow import Flow, FlowBuilder, Inputs, Message, Missing, Node, Policy, ReplayMismatch, digest, encoded, events, frame_digest, recorded_outputs
from tickstone.sources.pit_store import PitStore
from tickstone.operators.simulation import fold
from tickstone.plans.tools import BoundTools, OverBudget
from tickstone.streaming.ingest import append_stream, bar_stream, live_equity, live_features


def ticks(n):
    return [Tick.from_datetime(datetime(2026, 1, 5, 21, tzinfo=UTC) + timedelta(days=i), "close") for i in range(n)]


@dataclass(frozen=True)
class Number(Message):
    value: int


@dataclass(frozen=True)
class Double(Message):
    value: int


@dataclass(frozen=True)
class Rows(Message):
    frame: DataFrame


class Source(Node):
    name, writes = "Source", Number
    value = 21

    def run(self, ctx):
        return Number(ctx.tick, self.name, self.value)


class Doubler(Node):
    name, reads, writes = "Doubler", (Number,), Double

    def run(self, ctx):
        return Double(ctx.tick, self.name, 2 * ctx.inputs[Number].value)


class Reader(Node):
    name, reads, writes = "Reader", (Double,), Rows
    spark = None

    def run(self, ctx):
        return Rows(ctx.tick, self.name, self.spark.range(ctx.inputs[Double].value).withColumn("v", F.col("id") * 2))


def rows(path):
    return [json.loads(x) for x in path.read_text().splitlines()]


def test_ten_ticks_and_replay(spark, tmp_path):
    Reader.spark = spark
    flow = FlowBuilder().add(Reader()).add(Doubler()).add(Source()).build(spark=spark)
    assert [[n.name for n in x] for x in flow.levels] == [["Source"], ["Doubler"], ["Reader"]]
    out = flow.run_many(ticks(10), "r", tmp_path / "a.jsonl")
    assert len(out) == 10 and out[0][Double].value == 42 and out[0][Rows].frame.count() == 42
    log = rows(tmp_path / "a.jsonl")
    assert sum(r["event"] == "node_completed" for r in log) == 30
    assert recorded_outputs(events(spark, str(tmp_path / "a.jsonl")), "r").count() == 30
    assert len(flow.replay(spark, ticks(10), tmp_path / "a.jsonl", "r", tmp_path / "b.jsonl")) == 10
    Source.value = 5
    try:
        with pytest.raises(ReplayMismatch, match="changed"):
            flow.replay(spark, ticks(1), tmp_path / "a.jsonl", "r", tmp_path / "c.jsonl")
    finally:
        Source.value = 21
    with pytest.raises(ValueError):
        flow.replay(spark, ticks(1), tmp_path / "a.jsonl", "other", tmp_path / "d.jsonl")
    with pytest.raises(ValueError):
        flow.replay(spark, [], tmp_path / "a.jsonl", "r", tmp_path / "d.jsonl")


def test_clocks():
    line = Timeline(ticks(2))
    assert [c.tick() for c in line] == ticks(2) == [c.at for c in line] and len(line) == 2
    assert len(Timeline([ticks(1)[0]] * 2)) == 2  # ticks may share a time
    for bad in ([], ticks(2)[::-1]):
        with pytest.raises(ValueError):
            Timeline(bad)
    with pytest.raises(ValueError):
        Tick("x", datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        Tick("x", datetime(2026, 1, 1, tzinfo=UTC), "noon")
    with pytest.raises(AttributeError):
        Clock(ticks(1)[0]).at = ticks(2)[1]  # nothing moves a clock
    assert Clock(ticks(1)[0]).now() == ticks(1)[0].at


def test_digests_of_values(spark):
    a = {"b": (1, 2.5, None), "a": {"x", "y"}, "d": datetime(2026, 1, 1, tzinfo=UTC), "t": ticks(1)[0]}
    b = {"t": ticks(1)[0], "d": datetime(2026, 1, 1, tzinfo=UTC), "a": {"y", "x"}, "b": [1, 2.5, None]}
    assert digest(a) == digest(b) != digest(a | {"b": (2, 1)})
    assert encoded({"k": (True, "s")}) == {"k": [True, "s"]} and encoded(date(2026, 1, 2)) == "2026-01-02"
    assert digest(Number(ticks(1)[0], "n", 1)) != digest(Number(ticks(1)[0], "n", 2))
    assert digest(Rows(ticks(1)[0], "n", spark.range(5))) == digest(Rows(ticks(1)[0], "n", spark.range(5).repartition(3)))

    class Other:
        pass

    encoded.register(Other, lambda v: "other")
    assert encoded([Other()]) == ["other"]


def test_graph_checks():
    class Second(Source):
        name = "Second"

    class Loop(Node):
        name, reads, writes = "Loop", (Rows,), Double

        def run(self, ctx): ...

    class Back(Node):
        name, reads, writes = "Back", (Double,), Rows

        def run(self, ctx): ...

    class Stateful(Source):
        kind = "stateful"

    class Own(Node):
        name, reads, writes = "Own", (Number,), Number

        def run(self, ctx): ...

    for nodes in ([], [Doubler()], [Source(), Source()], [Source(), Second()], [Loop(), Back()], [Stateful(), Doubler()], [Own()], [Source(Policy(executor="gpu"))]):
        with pytest.raises(ValueError):
            Flow(nodes)
    p = Policy()
    assert (p.retries, p.required, p.timeout_s) == (0, True, 300.0)
    with pytest.raises(ValueError):
        Policy(timeout_s=0)


class Failing(Node):
    name, writes = "Failing", Number
    calls = 0

    def run(self, ctx):
        Failing.calls += 1
        raise RuntimeError("boom")


class Slow(Node):
    name, writes = "Slow", Double

    def run(self, ctx):
        time.sleep(0.4)
        return Double(ctx.tick, self.name, 1)


def test_required_failure(tmp_path):
    with pytest.raises(ExceptionGroup):
        Flow([Failing(), Slow()]).run(ticks(1)[0], "r", tmp_path / "l")
    log = rows(tmp_path / "l")
    assert log[-1]["event"] == "run_failed" and log[-1]["detail"] == "RuntimeError: boom"
    assert [r["node"] for r in log if r["event"] == "node_failed"] == ["Failing"]


def test_retry_optional_and_timeout(tmp_path):
    Failing.calls = 0

    class Tolerant(Node):
        name, reads, writes = "Tolerant", (Number,), Rows

        def run(self, ctx):
            assert isinstance(ctx.inputs.get(Number), Missing)
            with pytest.raises(RuntimeError):
                ctx.inputs[Number]
            with pytest.raises(KeyError):
                ctx.inputs[Double]
            return Rows(ctx.tick, self.name, None)

    out = Flow([Failing(Policy(retries=2, backoff_s=0.01, required=False)), Tolerant()]).run(ticks(1)[0], "r", tmp_path / "l")
    assert Failing.calls == 3 and out[Number].reason == "RuntimeError: boom"
    assert [r["event"] for r in rows(tmp_path / "l") if r.get("node") == "Failing"].count("node_retried") == 2
    with pytest.raises(ExceptionGroup) as e:
        Flow([Slow(Policy(timeout_s=0.05))]).run(ticks(1)[0], "r", tmp_path / "m")
    assert isinstance(e.value.exceptions[0], TimeoutError)


def test_wrong_messages(tmp_path):
    class WrongType(Source):
        def run(self, ctx):
            return Double(ctx.tick, self.name, 1)

    class WrongTick(Source):
        def run(self, ctx):
            return Number(ticks(5)[4], self.name, 1)

    for n in (WrongType(), WrongTick()):
        with pytest.raises(ExceptionGroup):
            Flow([n]).run(ticks(1)[0], "r", tmp_path / "l")
    with pytest.raises(ValueError):
        Flow([Source()]).run(ticks(2)[1], "r", tmp_path / "l", Clock(ticks(1)[0]))
    with pytest.raises(TypeError):
        Inputs({Number: Double(ticks(1)[0], "x", 1)})[Number]


def test_frame_digest(spark):
    a = spark.range(100).withColumn("s", F.lit(None).cast("string"))
    assert frame_digest(a) == frame_digest(a.repartition(7).select("s", "id"))
    assert frame_digest(a) != frame_digest(a.unionByName(a.limit(1))) != frame_digest(a.limit(0))


def test_stream_appends_once(spark, tmp_path):
    landing, store = tmp_path / "in", PitStore(spark, str(tmp_path / "s"))
    frame(spark, [bar("A", "2025-01-02", 1.0), bar("B", "2025-01-02", 2.0)]).write.parquet(str(landing))
    seen = []
    append_stream(bar_stream(spark, str(landing)), store, str(tmp_path / "c"), lambda _, n: seen.append(n)).awaitTermination()
    frame(spark, [bar("A", "2025-01-02", 9.0), bar("A", "2025-01-03", 3.0)]).write.mode("append").parquet(str(landing))
    append_stream(bar_stream(spark, str(landing)), store, str(tmp_path / "c"), lambda _, n: seen.append(n)).awaitTermination()
    assert seen == [2, 1]
    assert tuples(store.read(datetime(2025, 2, 1, tzinfo=UTC)), "symbol", "close") == [("A", 1.0), ("A", 3.0), ("B", 2.0)]


def test_stream_features_are_the_batch_ones(spark, tmp_path):
    data = [("A" if i % 2 else "B", i, 10.0 + (i * 7 % 11) / 10) for i in range(60)]
    schema = "symbol string, session_us bigint, close double"
    for k in range(3):
        spark.createDataFrame(data[20 * k : 20 * k + 20][::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_features(stream, 30).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = add_features(spark.createDataFrame(data, schema).withColumn("available_at", F.col("session_us")), order="session_us")
    cols = ["symbol", "session_us", "ret_1", "ret_5", "vol_20"]
    a, b = tuples(spark.table("live").fillna(-9.0), *cols), tuples(batch.fillna(-9.0), *cols)
    assert len(a) == 60 and all(x[:2] == y[:2] and all(abs(p - q) < 1e-12 for p, q in zip(x[2:], y[2:], strict=True)) for x, y in zip(a, b, strict=True))
    with pytest.raises(ValueError):
        live_features(stream, 5)


def test_demo_run_and_replay(spark, tmp_path):
    from tickstone.plans.research import AS_OF, Evaluation, research_flow, run_demo
    from tickstone.sources.files import CsvBars

    out = run_demo(spark, tmp_path, iterations=2)
    assert out[Evaluation].values["eval_rows"] == 640 and out[Evaluation].values["train_rows"] == 3860
    card = json.loads((tmp_path / "card.json").read_text())
    data = card["data"]
    assert (data["visible_rows"], data["excluded_rows"], data["feature_rows"]) == (4565, 50, 4510) and len(data["sha256"]) == 64 and data["as_of"].startswith("2023-06-30T23:59")
    assert card["model"]["class"] == "GBTRegressionModel" and card["model"]["parameters"]["maxIter"] == 2 and card["model"]["features"] == ["ret_1", "ret_5", "vol_20"] and card["model"]["trees"] == 2
    flow = research_flow(spark, CsvBars(spark, str(tmp_path / "bars")), iterations=2)
    assert len(flow.replay(spark, [Tick.from_datetime(AS_OF)], tmp_path / "events.jsonl", "demo", tmp_path / "again.jsonl")) == 1


def test_late_rows_are_handed_out(spark, tmp_path):
    schema = "symbol string, session_us bigint, close double"
    for part in ([("A", 10, 1.0), ("A", 12, 2.0)], [("A", 11, 9.0), ("A", 13, 4.0), ("A", 12, 9.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_features(stream, 30).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert tuples(spark.table("late"), "session_us", "close", "late", "ret_1") == [(10, 1.0, False, None), (11, 9.0, True, None), (12, 2.0, False, 1.0), (12, 9.0, True, None), (13, 4.0, False, 1.0)]


def test_live_equity_is_the_folded_one(spark, tmp_path):
    terms = [(r, datetime(2026, 1, d, tzinfo=UTC), 0.01 * (d % 3 - 1), 0.02 * (d % 2), 0.1, 1e-4, 1e-5) for r in ("x", "y") for d in range(1, 10)]
    schema = "run string, event_time timestamp, r_over double, r_in double, turnover double, a double, b double"
    for k in range(3):
        spark.createDataFrame([t for t in terms if t[1].day // 4 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live_equity(stream, 500.0).writeStream.format("memory").queryName("equity").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = fold(spark.createDataFrame(terms, schema), 500.0, "run")
    cols = ["run", "event_time", *(F.round(c, 9) for c in ("gross_return", "transaction_costs", "turnover", "net_return", "equity"))]
    assert tuples(spark.table("equity"), *cols) == tuples(want, *cols)


def test_tools(spark):
    bars = [bar(" a", f"2026-01-{d:02}", 10.0 + d, late=1) for d in range(1, 29)] + [bar("B", "2026-01-02", 5.0)]
    docs = spark.createDataFrame(
        [(i, f"text {i}", s, "A ", f, datetime(2026, 1, i, tzinfo=UTC), datetime(2026, 1, i, 6 if i != 9 else 23, tzinfo=UTC)) for i, (s, f) in enumerate([("Filings", "10-K"), ("filings", "10-K "), ("newswire", None), ("filings", "8-K"), ("Newswire", None), ("filings", "10-k"), ("newswire", None), ("newswire", None), ("filings", "10-K")], 1)],
        "doc_id bigint, text string, source string, symbol string, form string, event_time timestamp, available_at timestamp",
    )
    tick = Tick.from_datetime(datetime(2026, 1, 9, 12, tzinfo=UTC))
    tools = BoundTools(Clock(tick), frame(spark, bars), docs, scorer=lambda rows: rows.withColumn("prediction", F.lit(0.5)), budget=7)
    assert [s["name"] for s in tools.schemas()] == ["get_features", "predict", "get_price_history", "get_filing", "get_news", "check_risk"]
    assert [r.close for r in tools.call("get_price_history", {"symbol": "a ", "lookback_days": 3}).collect()] == [16.0, 17.0, 18.0]
    got = tools.call("get_features", {"symbol": "A", "names": ["ret_1", "vol_20"]}).first()
    assert abs(got.ret_1 - (18 / 17 - 1)) < 1e-12 and got.vol_20 is None
    assert tools.call("predict", {"symbol": "A"}).count() == 0  # eight bars are too few for vol_20
    assert [r.doc_id for r in tools.call("get_filing", {"symbol": "A", "form": "10-k", "n": 2}).orderBy("place").collect()] == [6, 2]
    assert [r.doc_id for r in tools.call("get_news", {"symbol": "A", "lookback_hours": 72}).collect()] == [8, 7]
    assert tools.call("check_risk", {"weights": {"A": 0.5}}).first().bound == ["max_name_weight"]
    for bad in (("nothing", {}), ("predict", {"symbol": "A", "x": 1})):
        with pytest.raises((KeyError, TypeError)):
            tools.call(*bad)
    assert tools.call("get_news", {"symbol": "zz", "lookback_hours": 1}).count() == 0
    with pytest.raises(OverBudget):
        tools.call("predict", {"symbol": "A"})
