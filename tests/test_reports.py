from __future__ import annotations

from datetime import UTC, datetime

from helpers import tuples

from tickstone.plans.reports import Registry, checked_scores, one_of_ranking, run_report, store_payload
from tickstone.schemas import EVENT


def test_payload_by_content(spark, tmp_path):
    a = store_payload(spark.range(10), str(tmp_path))
    assert a == store_payload(spark.range(10).repartition(3), str(tmp_path)) != store_payload(spark.range(9), str(tmp_path))
    assert spark.read.parquet(a).count() == 10


def test_run_report(spark):
    def e(event, node=None, status=None, ms=None, run="r"):
        return (event, run, "t", node, None, None, status, ms, None, None, None, None, None, None)

    rows = [e("tick_started"), e("node_completed", "a", "ok", 5.0), e("node_retried", "b"), e("node_completed", "b", "missing"), e("node_completed", "c", "ok", 5.0), e("node_failed", "d"), e("run_completed", run=None)]
    got = run_report(spark.createDataFrame(rows, EVENT)).collect()
    assert len(got) == 1 and got[0].asDict() == {"run_id": "r", "tick": "t", "nodes": 4, "ok": 2, "missing": 1, "failed": 1, "retries": 1, "duration_ms": 10.0, "slowest": "a"}
    assert run_report(spark.createDataFrame([], EVENT)).count() == 0


def test_registry(spark, tmp_path):
    r = Registry(spark, str(tmp_path / "r"))
    for i, v in enumerate((3.0, 1.0, 1.0, float("nan"))):
        r.add(f"run{i}", "m", {"depth": i}, {"rmse": v}, datetime(2025, 1, 1 + i, tzinfo=UTC))
    r.add("other", "n", {}, {})
    assert tuples(r.best("rmse"), "run_id", "value") == [("run1", 1.0)] and tuples(r.best("rmse", highest=True), "run_id") == [("run0",)]


def test_checked_scores(spark):
    rows = [
        ('{"score": 0.5, "evidence": "net rose"}', "the net rose fast"),
        ('{"score": 2, "evidence": "net rose"}', "the net rose fast"),
        ('{"score": 0.5, "evidence": "net fell"}', "the net rose fast"),
        ("no json", "x"),
        ('{"score": 0.1}', "x"),
        (None, "x"),
        ('{"score": 0.5, "evidence": "x"}', None),
    ]
    got = [r.problem for r in checked_scores(spark.createDataFrame(rows, "answer string, source string")).collect()]
    assert got == [None, "range", "evidence", "format", "format", "format", "evidence"]


def test_one_of_ranking(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", None), (2, "a", 0.0)], "tick int, symbol string, score double")
    assert tuples(one_of_ranking(s, "a"), "tick", "rank", "of") == [(1, 2, 3), (2, 1, 1)]
    assert one_of_ranking(s, "zz").count() == 0
