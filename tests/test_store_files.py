from __future__ import annotations

import hashlib
import json
import threading
import time
from datetime import UTC, date, datetime, timedelta

import pytest
from helpers import bar, frame, session_frame, tuples
from pyspark.sql import functions as F

from tickstone.operators.bars import close_of, daily_to_pit, visible_at_ticks
from tickstone.schemas import RAW_BAR
from tickstone.sources.atomic import write_text
from tickstone.sources.calendar import holidays, sessions, short_sessions, weekdays
from tickstone.sources.dataset import build_dataset
from tickstone.sources.files import CsvBars, file_hashes, holdings, publish, raw_bars, synthetic_bars, universe_members, write_card, write_csv, write_universe
from tickstone.sources.pit_store import PitStore, aware
from tickstone.sources.storage import Lease, LeaseLost, Storage

NOW = datetime(2025, 2, 1, tzinfo=UTC)


def test_write_is_idempotent_and_first_wins(spark, tmp_path):
    store = PitStore(spark, str(tmp_path / "s"))
    assert store.read(NOW).count() == 0 and store.coverage().first().rows == 0
    first = frame(spark, [bar("A", "2025-01-02", 1.0), bar("A", "2025-01-02", 2.0, late=3), bar("B", "2024-12-31", 3.0)])
    assert store.write(first) == 2
    assert store.write(first) == 0
    assert store.write(frame(spark, [bar("A", "2025-01-02", 9.0), bar("A", "2025-01-03", 4.0)])) == 1
    assert tuples(store.read(NOW), "symbol", "close") == [("A", 1.0), ("A", 4.0), ("B", 3.0)]
    assert store.coverage().first().asDict()["symbols"] == 2
    assert store.write(frame(spark, [])) == 0


def test_a_store_behind_a_uri(spark, tmp_path):
    root = f"file:{tmp_path}/deep/s"
    store = PitStore(spark, root)
    assert store.read(NOW).count() == 0 and store.write(frame(spark, [bar("A", "2025-01-02", 1.0)])) == 1
    assert store.write(frame(spark, [bar("A", "2025-01-02", 2.0)])) == 0 and store.write(frame(spark, [bar("A", "2025-01-03", 2.0)])) == 1
    assert tuples(PitStore(spark, f"{tmp_path}/deep/s").read(NOW), "close") == [(1.0,), (2.0,)] and store.coverage().first().rows == 2
    from tickstone.plans.reports import store_payload

    path = store_payload(spark.range(3), f"file:{tmp_path}/p")
    assert store_payload(spark.range(3), f"file:{tmp_path}/p") == path and Storage(spark).exists(f"{path}/_SUCCESS")


def test_writers_take_turns(spark, tmp_path):
    storage, folder = Storage(spark), f"file:{tmp_path}/x.lease"
    order = []

    def writer(k):
        with Lease(storage, folder).taken(pause=0.01):
            order.append((k, "in"))
            time.sleep(0.05)
            order.append((k, "out"))

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(order) == 8 and all(a[0] == b[0] and (a[1], b[1]) == ("in", "out") for a, b in zip(order[::2], order[1::2], strict=True))
    # a dead writer's turn ends; a holder that was taken over is told
    assert storage.create(f"{folder}/{99:012}", json.dumps({"owner": "dead", "until": time.time() - 1}).encode())
    with pytest.raises(LeaseLost):
        with Lease(storage, folder).taken() as lease:
            assert lease.turn == 100 and lease.held()
            assert storage.create(f"{folder}/{101:012}", json.dumps({"owner": "other", "until": time.time() + 60}).encode())
    with pytest.raises(TimeoutError):
        with Lease(storage, folder).taken(wait=0.1, pause=0.01):
            pass
    slow = Lease(storage, f"{tmp_path}/y.lease", lifetime=0.3)
    with slow.taken():
        time.sleep(0.6)  # renewed meanwhile
        assert not slow._last()[1] and slow.held()


def test_files_are_whole_on_any_storage(spark, tmp_path):
    s, f = Storage(spark), f"file:{tmp_path}/a b/c.txt"
    s.write(f, b"one")
    s.write(f, b"two\x00")
    assert s.read(f) == b"two\x00" and s.names(f"{tmp_path}/a b") == ["c.txt"] and s.names(f"{tmp_path}/none") == []
    assert not s.create(f, b"three") and s.create(f + "2", b"three") and s.read(f"{tmp_path}/a b/c.txt2") == b"three"
    s.copy(f, f"{tmp_path}/d/e.txt")
    assert s.sha256(f"{tmp_path}/d/e.txt") == hashlib.sha256(b"two\x00").hexdigest() and s.names(f"{tmp_path}/d") == ["e.txt"]
    s.delete(f)
    assert not s.exists(f) and s.any(f"file:{tmp_path}/*/e.txt") and not s.any(f"{tmp_path}/*/none")
    assert s.inside(f"file:{tmp_path}", f"file:{tmp_path}/d/e.txt") == "d/e.txt"


def test_read_filters(spark, tmp_path):
    store = PitStore(spark, str(tmp_path / "s"))
    store.write(frame(spark, [bar("A", "2025-01-02"), bar("B", "2025-01-03"), bar("A", "2025-01-06")]))
    at = datetime(2025, 1, 6, 21, 14, tzinfo=UTC)
    assert store.read(at).count() == 2 and store.read(at + timedelta(minutes=1)).count() == 3
    assert store.read(NOW, symbols=[]).count() == 0 and store.read(NOW, symbols=["B"]).count() == 1
    assert store.read(NOW, start=datetime(2025, 1, 3, 21, tzinfo=UTC), end=datetime(2025, 1, 6, 21, tzinfo=UTC)).count() == 1
    plan = store.read(NOW, start=datetime(2025, 1, 3, tzinfo=UTC))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThanOrEqual(available_at" in plan
    with pytest.raises(ValueError):
        store.read(datetime(2025, 1, 1))


def test_leakage(spark, tmp_path):
    """What is not yet available must not change a read."""
    seen = []
    for future in (101.0, 999.0):
        store = PitStore(spark, str(tmp_path / f"s{future}"))
        store.write(frame(spark, [bar("A", "2025-01-02", 100.0), bar("A", "2025-01-03", future)]))
        seen.append(tuples(store.read(datetime(2025, 1, 3, 21, 14, tzinfo=UTC)), "symbol", "event_time", "close"))
    assert seen[0] == seen[1] and len(seen[0]) == 1


def test_write_refuses_bars_from_the_future(spark, tmp_path):
    with pytest.raises(TypeError, match="close is string"):
        PitStore(spark, str(tmp_path / "s")).write(frame(spark, [bar("A", "2025-01-02")]).withColumn("close", F.col("close").cast("string")))
    with pytest.raises(ValueError):
        PitStore(spark, str(tmp_path / "s")).write(frame(spark, [bar("A", "2025-01-02", late=-1)]))
    with pytest.raises(ValueError):
        aware(datetime(2025, 1, 1))


def test_daily_bar_gets_its_close(spark):
    raw = spark.createDataFrame([("A", datetime(2026, 10, d, 4, tzinfo=UTC), 1.0, 1.0, 1.0, 1.0, 100.0, None, 7) for d in (15, 16, 17)], RAW_BAR)
    calendar = spark.createDataFrame([(date(2026, 10, 15), datetime(2026, 10, 15, 17, tzinfo=UTC))], "session_date date, close_utc timestamp")
    got = [(r.event_time.astimezone(UTC).isoformat()[:16], (r.available_at - r.event_time).total_seconds()) for r in daily_to_pit(raw, calendar).orderBy("event_time").collect()]
    assert got == [("2026-10-15T17:00", 900.0), ("2026-10-16T20:00", 900.0), ("2026-10-17T20:00", 900.0)]
    assert daily_to_pit(raw.limit(0), calendar).count() == 0
    with pytest.raises(ValueError):
        daily_to_pit(raw, calendar, timedelta(minutes=-1))
    winter = spark.range(1).select(F.unix_micros(close_of(F.lit("2026-01-15").cast("date"))).alias("us")).first().us
    assert datetime.fromtimestamp(winter / 1e6, UTC).hour == 21


def test_visible_at_ticks(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("b", 3, "z"), ("b", None, "n"), ("c", 99, "late")], "k string, available_at int, v string")
    ticks = spark.createDataFrame([(0,), (1,), (4,), (5,), (9,), (9,), (None,)], "tick_at int")
    got = tuples(visible_at_ticks(rows, ticks, "k"), "k", "tick_at", "v")
    assert got == [("a", 1, "x"), ("a", 4, "x"), ("a", 5, "y"), ("a", 9, "y"), ("b", 4, "z"), ("b", 5, "z"), ("b", 9, "z")]
    assert visible_at_ticks(rows, ticks.limit(0), "k").count() == 0 and visible_at_ticks(rows.limit(0), ticks, "k").count() == 0


def test_calendar_rules():
    assert {date(2025, 4, 18), date(2025, 6, 19), date(2025, 11, 27)} <= holidays(2025) and date(2021, 12, 31) not in holidays(2021) | holidays(2022)
    assert date(2026, 7, 3) in holidays(2026) and date(2025, 7, 3) in short_sessions(2025)
    assert len(sessions(date(2025, 1, 1), date(2025, 12, 31))) == 251 and len(sessions(date(2025, 1, 1), date(2025, 1, 10), [date(2025, 1, 9)])) == 6
    assert len(list(weekdays(date(2020, 1, 1), date(2023, 7, 14)))) == 923


def test_csv_source(spark, tmp_path):
    panel = synthetic_bars(spark)
    assert panel.count() == 4615
    write_csv(panel.selectExpr("symbol", "cast(session as string) session", "date_format(available_at, \"yyyy-MM-dd'T'HH:mm:ss+00:00\") available_at", "close"), str(tmp_path / "b"))
    got, hidden = CsvBars(spark, str(tmp_path / "b")).load_as_of(datetime(2023, 6, 30, 23, 59, tzinfo=UTC))
    assert (got.count(), hidden) == (4565, 50)
    with pytest.raises(ValueError):
        CsvBars(spark, str(tmp_path / "b")).load_as_of(datetime(2023, 6, 30))


def test_raw_bars(spark, tmp_path):
    rows = [("A", datetime(2025, 1, d, 5, tzinfo=UTC), *[1.0] * 5, None, None) for d in (2, 3, 4)]
    spark.createDataFrame(rows, RAW_BAR).coalesce(1).write.parquet(str(tmp_path / "A.parquet"))
    got, absent = raw_bars(spark, str(tmp_path), ["A", "B"], date(2025, 1, 3), date(2025, 1, 4))
    assert got.count() == 1 and absent == ["B"]
    assert raw_bars(spark, str(tmp_path), ["B"])[0].count() == 0


HOLDINGS = """Some fund
Fund Holdings as of,"Oct 15, 2026"

Ticker,Name,Asset Class,Location,Exchange
"BRK B",X,Equity,United States,NYSE
 aapl,Y,Equity,United States,NASDAQ
aapl,Y,Equity,United States,NASDAQ
USD,Cash,Cash,United States,-
SAP,Z,Equity,Germany,NASDAQ
OTC,Q,Equity,United States,OTC
,W,Equity,United States,NASDAQ
"""


def test_holdings(spark):
    at, df = holdings(spark, HOLDINGS)
    assert at == date(2026, 10, 15) and [r.symbol for r in df.collect()] == ["AAPL", "BRK.B"]
    for broken in ("", HOLDINGS.replace("Fund Holdings", "x"), HOLDINGS.replace("Ticker,", "T,"), HOLDINGS.replace("Equity", "Bond"), HOLDINGS.replace("Oct 15", "Foo 15")):
        with pytest.raises(ValueError):
            holdings(spark, broken)


def test_dataset(spark, tmp_path):
    write_universe(tmp_path / "u.json", "I", "P", date(2025, 1, 1), NOW, ["A", "B", "C"])
    for s in ("A", "B"):
        rows = [(s, datetime(2025, 1, d, 5, tzinfo=UTC), *[1.0 * d] * 5, None, None) for d in (2, 3, 6)]
        spark.createDataFrame(rows, RAW_BAR).coalesce(1).write.parquet(str(tmp_path / f"raw/{s}.parquet"))
    args = (spark, tmp_path / "u.json", str(tmp_path / "raw"), str(tmp_path / "store"), tmp_path / "out", session_frame(spark), date(2025, 1, 3), date(2025, 1, 7))
    first, again = build_dataset(*args), build_dataset(*args)
    assert (first.inserted, first.absent, again.inserted) == (4, ["C"], 0) and first.snapshot_id == again.snapshot_id
    body = json.loads((tmp_path / "out/snapshots" / first.snapshot_id / "manifest.json").read_text())
    assert body["source"] == "" and set(body["coverage"]) == {"rows", "symbols", "first_event_time", "last_event_time"} and body["coverage"]["last_event_time"] == "2025-01-06T21:00:00Z"
    assert body["coverage"]["rows"] == 4 and body["coverage"]["symbols"] == 2 and set(body["source_bar_file_sha256"]) == {"A", "B"}
    assert PitStore(spark, str(tmp_path / "out/snapshots" / first.snapshot_id / "bars")).read(NOW).count() == 4
    with pytest.raises(ValueError):
        build_dataset(*args[:-2], date(2025, 1, 7), date(2025, 1, 3))


def test_universe_and_snapshots(spark, tmp_path):
    write_universe(tmp_path / "u.json", "I", "P", date(2025, 1, 1), NOW, ["B", "A", "B"])
    assert [r.symbol for r in universe_members(spark, str(tmp_path / "u.json")).collect()] == ["A", "B"]
    write_text(tmp_path / "in/f.txt", "hello")
    digest = hashlib.sha256(b"hello").hexdigest()
    assert [r.sha256 for r in file_hashes(spark, str(tmp_path / "in")).collect()] == [digest]
    files = {"bars/f.txt": tmp_path / "in/f.txt"}
    name = publish(tmp_path / "d", files, {"files": {"bars/f.txt": digest}}, {"bars/f.txt": digest})
    assert publish(tmp_path / "d", files, {"files": {"bars/f.txt": digest}}, {"bars/f.txt": digest}) == name
    assert json.loads((tmp_path / "d/current.json").read_text())["snapshot_id"] == name
    (tmp_path / "d/snapshots" / name / "bars/f.txt").write_text("other")
    with pytest.raises(ValueError):
        publish(tmp_path / "d", files, {"files": {"bars/f.txt": digest}}, {"bars/f.txt": digest})
    write_card(tmp_path / "card.json", {"b": 1, "a": NOW})
    assert list(json.loads((tmp_path / "card.json").read_text())) == ["a", "b"]


def test_sessions_table_matches_rules(spark):
    assert session_frame(spark).count() == 40
