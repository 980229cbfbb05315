from __future__ import annotations

import random
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pyarrow as pa
from helpers import tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickstone.operators.history import VERSION, _joined, file_history, history, membership_history, merge_order, merged_versions
from tickstone.operators.snapshot_diff import delivery_changes, file_cells, member_cells, snapshot_diff

UNIVERSE = "index_name string, as_of string, retrieved_at timestamp, symbols array<string>"
MANIFEST = "store_name string, universe_as_of string, published_at timestamp, curated_files_sha256 map<string,string>"


def t(n):
    return datetime(2025, 6, 1, tzinfo=UTC) + timedelta(hours=n)


def universe(spark, rows):
    return spark.createDataFrame(rows, UNIVERSE)


def test_history_of_members(spark):
    rows = [
        ("I", "2025-01-01", t(1), ["a", "b", "a "]),
        ("I", "Jan 02, 2025", t(2), ["a", None, " "]),
        ("I", "2025-01-03", t(3), None),
        ("I", "2025-01-04", t(4), []),
        ("I", "2025-01-05", t(5), ["wrong"]),
        ("I", "2025-01-05", t(6), ["A", "b\t", "c d"]),
        ("I", "2025-01-05", t(7), []),
        ("I", "2025-01-06", t(8), ["c d"]),
        ("I", "nonsense", t(9), ["z"]),
        (None, "2025-01-06", t(9), ["z"]),
        ("I", "2025-01-06", t(8), ["c d"]),
    ]
    assert tuples(membership_history(universe(spark, rows))) == [
        ("I", "A", "2025-01-01", "2025-01-06"),
        ("I", "B", "2025-01-01", "2025-01-02"),
        ("I", "B", "2025-01-05", "2025-01-06"),
        ("I", "C.D", "2025-01-05", ""),
    ]


def test_changes_of_members_and_files(spark):
    u = universe(spark, [("I", "2025-01-01", t(1), ["a", "b"]), ("I", "2025-01-02", t(2), ["b", "c"]), ("I", "2025-01-03", None, ["B", "C"])])
    m = spark.createDataFrame(
        [
            ("S", "2025-01-01", t(1), {"./x": "sha256:AA", "y": "bb", "z": "1"}),
            ("S", "2025-01-02", t(2), {"x": "aa", "y": "cc", "./y": "CC", "w": None}),
            ("S", "2025-01-02", t(3), {}),
            ("S", "2025-01-02", t(3), None),
            ("S", "2025-01-03", t(4), {"x": "aa", "y": "cc", "w": "d"}),
        ],
        MANIFEST,
    )
    assert tuples(delivery_changes(u, m), "scope", "as_of", "item", "change") == [
        ("I", "2025-01-02", "A", "removed"),
        ("I", "2025-01-02", "C", "added"),
        ("S", "2025-01-02", "w", "added"),
        ("S", "2025-01-02", "y", "changed"),
        ("S", "2025-01-02", "z", "removed"),
        ("S", "2025-01-03", "w", "changed"),
    ]
    assert {tuple(r.fields) for r in snapshot_diff(file_cells(m)).where("change = 'changed'").collect()} == {("sha256",)}


def test_equal_instants_are_decided_the_same_way(spark):
    rows = [("I", "2025-01-01", t(1), ["a"]), ("I", "2025-01-01", t(1), ["b"])]
    assert tuples(membership_history(universe(spark, rows))) == tuples(membership_history(universe(spark, rows[::-1])))


def test_empty(spark):
    assert membership_history(universe(spark, [])).count() == 0
    assert snapshot_diff(member_cells(universe(spark, []))).count() == 0
    assert delivery_changes(universe(spark, []), spark.createDataFrame([], MANIFEST)).count() == 0


def test_extra_columns(spark):
    df = universe(spark, [("I", "2025-01-01", t(1), ["a"])]).selectExpr("*", "1 AS scope", "2 AS seq", "3 AS items", "4 AS entity")
    assert membership_history(df).count() == 1


SNAPSHOTS = "scope string, block int, seq int, as_of date, next_as_of date, entries array<struct<entity:string,payload:string>>"


def day(n):
    return date(2025, 1, n)


def test_payload_changes_close_versions(spark):
    rows = [("s", 0, i, day(i), day(i + 1) if i < 5 else None, [("e", p)]) for i, p in enumerate(["x", "x", "y", None, None], 1)]
    got = [tuple(r) for r in history(spark.createDataFrame(rows, SNAPSHOTS)).orderBy("valid_from").collect()]
    assert got == [("s", "e", "x", "2025-01-01", "2025-01-03"), ("s", "e", "y", "2025-01-03", "2025-01-04"), ("s", "e", None, "2025-01-04", "")]
    twice = spark.createDataFrame([("s", 0, 1, day(1), None, [("e", "a"), (None, "z"), ("e", "b"), ("e", None)])], SNAPSHOTS)
    assert [tuple(r) for r in history(twice).collect()] == [("s", "e", "b", "2025-01-01", "")]
    assert history(spark.createDataFrame([("s", 0, 1, day(1), None, []), ("s", 0, 2, day(2), None, None)], SNAPSHOTS)).count() == 0


def test_history_of_files(spark):
    m = spark.createDataFrame(
        [
            ("S", "2025-01-01", t(1), {"./x": "sha256:AA", "y": "bb"}),
            ("S", "2025-06-02", t(2), {"x": "aa", "y": "cc", "./y": "CC", "w": None, " ": "1"}),
            ("S", "2025-12-03", t(4), {"x": "aa", "y": "bb", "w": None}),
        ],
        MANIFEST,
    )
    assert tuples(file_history(m)) == [
        ("S", "w", None, "2025-06-02", ""),
        ("S", "x", "aa", "2025-01-01", ""),
        ("S", "y", "bb", "2025-01-01", "2025-06-02"),
        ("S", "y", "bb", "2025-12-03", ""),
        ("S", "y", "cc", "2025-06-02", "2025-12-03"),
    ]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12).map(sorted), max_size=9))
def test_merge_order(runs):
    got = merge_order([np.array(r, np.int64) for r in runs])
    flat = [x for r in runs for x in r]
    assert list(got) == sorted(range(len(flat)), key=lambda i: flat[i])


def _brute(rows):
    standing = {}
    for i, d, at, symbols in rows:
        if symbols and (i, d) not in standing or symbols and standing[i, d][0] < at:
            standing[i, d] = (at, {s.strip().upper() for s in symbols})
    stays, changes = set(), set()
    for i in {i for i, _ in standing}:
        days = sorted(d for j, d in standing if j == i)
        for s in set().union(*(standing[i, d][1] for d in days)):
            begun = None
            for d in days:
                if s in standing[i, d][1]:
                    begun = begun or d
                elif begun:
                    stays.add((i, s, begun, d))
                    begun = None
            if begun:
                stays.add((i, s, begun, ""))
        for a, b in zip(days, days[1:], strict=False):
            x, y = standing[i, a][1], standing[i, b][1]
            changes |= {(i, b, s, "added") for s in y - x} | {(i, b, s, "removed") for s in x - y}
    return sorted(stays), sorted(changes)


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows, n = [], 0
    for i in ("I", "J", "K"):
        for k in range(25):
            for _ in range(rng.choice([1, 1, 2, 3])):
                n += 1
                rows.append((i, str(date(2025, 1, 1) + timedelta(days=3 * k)), t(n), rng.choice([None, [], *[rng.sample("abcdefgh", 5) for _ in range(6)]])))
    stays, changes = _brute(rows)
    assert tuples(membership_history(universe(spark, rows))) == stays
    assert tuples(snapshot_diff(member_cells(universe(spark, rows))), "scope", "as_of", "item", "change") == changes


def _snapshot_batch(rows):
    """One Arrow batch of snapshots from ``scope, entity, seq, payload``."""
    groups = {}
    for scope, entity, seq, payload in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault((scope, seq), []).append((entity, payload))
    if not groups:
        return None
    columns = {"scope": [k[0] for k in groups], "seq": pa.array([k[1] for k in groups], pa.int32()), "as_of": [day(k[1]) for k in groups], "next_as_of": [day(k[1] + 1) for k in groups]}
    columns["entities"] = pa.array([[e for e, _ in v] for v in groups.values()], pa.list_(pa.string()))
    columns["payloads"] = pa.array([[p for _, p in v] for v in groups.values()], pa.list_(pa.string()))
    return pa.RecordBatch.from_pydict(columns)


@settings(max_examples=80, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from("IJ"), st.sampled_from("abc"), st.integers(1, 12), st.sampled_from(["x", "y", None])), max_size=50, unique_by=lambda r: r[:3]), st.integers(1, 7), st.integers(1, 5))
def test_merge_does_not_depend_on_batches(rows, size, cut):
    """The versions of all snapshots at once, and of snapshots in batches whose versions are joined in batches again."""
    whole = _snapshot_batch(rows)
    if whole is None:
        return
    names = [c.split()[0] for c in VERSION.split(", ")]
    want = [tuple(r.values()) for b in merged_versions(iter([whole])) for r in b.to_pylist()]
    parts = pa.Table.from_batches(list(merged_versions(whole.slice(i, size) for i in range(0, whole.num_rows, size))))
    ordered = parts.sort_by([(c, "ascending") for c in ("scope", "entity", "seq")])
    got = [tuple(r[c] for c in names) for b in _joined(iter(ordered.combine_chunks().to_batches(max_chunksize=cut))) for r in b.to_pylist()]
    key = lambda r: (r[0], r[1], r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    brute = []
    for scope, entity, seq, payload in sorted(rows, key=lambda r: r[:3]):
        if brute and brute[-1][:3] == [scope, entity, payload] and brute[-1][4] == seq - 1:
            brute[-1][4] = seq
        else:
            brute.append([scope, entity, payload, seq, seq])
    assert sorted((list(r[:5]) for r in got), key=key) == sorted(brute, key=key)
