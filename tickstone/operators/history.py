"""History of changing entity attributes from periodic full snapshots.

Each snapshot's rows are sorted by entity, and consecutive snapshots of a scope lie in one task. There the sorted snapshots are merged, k at a
time, into one run by (entity, time), from which versions fall out: one ends where the payload changes or a snapshot leaves
the entity out. Versions cut at the edge of a task are moved by (scope, entity) and joined by a pass in the same order that holds
the open version of the present entity only. So what crosses the network are versions, not rows of snapshots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstone.functions.columns import day_text, norm_hash, norm_path, norm_symbol, parse_day, strip
from tickstone.operators.deliveries import standing

KEYS = ["scope", "entity"]
VERSION = "scope string, entity string, payload string, seq int, last int, as_of date, next_as_of date"


def merge_order(runs: list[np.ndarray]) -> np.ndarray:
    """The order that merges sorted runs, as places in their concatenation; of equal keys those of an earlier run come first.

    Neighbouring runs are merged two by two until one is left: k runs take log2(k) rounds, each linear in the rows.
    """
    at = np.cumsum([0, *map(len, runs)])
    merged = [(r, np.arange(a, a + len(r))) for r, a in zip(runs, at, strict=False)]
    while len(merged) > 1:
        ahead = []
        for (x, i), (y, j) in zip(merged[::2], merged[1::2], strict=False):
            place = np.searchsorted(x, y, side="right") + np.arange(len(y))
            from_y = np.zeros(len(x) + len(y), bool)
            from_y[place] = True
            keys, order = np.empty(len(from_y), x.dtype), np.empty(len(from_y), np.int64)
            keys[from_y], keys[~from_y] = y, x
            order[from_y], order[~from_y] = j, i
            ahead.append((keys, order))
        merged = ahead + merged[len(ahead) * 2 :]
    return merged[0][1] if merged else np.zeros(0, np.int64)


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers of texts in their order; nulls are -1."""
    coded = values.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    index = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(index >= 0, rank[index] if len(rank) else -1, -1)


def merged_versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions within each batch of snapshots ``scope, seq, as_of, next_as_of, entities, payloads``, sorted by (scope, seq).

    ``entities`` of a snapshot are sorted and distinct, ``payloads`` lie beside them. A scope's last version of an entity in a batch may go on
    in the next one; ``last`` is the number of the last snapshot of a version.
    """
    for b in batches:
        lists = b.column("entities")
        size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        if not size.sum():
            continue
        snapshot = np.repeat(np.arange(b.num_rows), size)
        entities, payloads = lists.flatten(), b.column("payloads").flatten()
        entity, payload = _codes(entities), _codes(payloads)
        scope, seq = _codes(b.column("scope")), b.column("seq").to_numpy()
        key = scope[snapshot] * (int(entity.max()) + 1) + entity
        ends = np.cumsum(size)
        order = merge_order([key[e - n : e] for e, n in zip(ends, size, strict=True) if n])
        key, payload, at = key[order], payload[order], seq[snapshot[order]]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (payload[1:] != payload[:-1]) | (at[1:] - at[:-1] != 1)
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(key)) - 1
        began, ended = snapshot[order[first]], snapshot[order[end]]
        yield pa.RecordBatch.from_arrays(
            [b.column("scope").take(pa.array(began)), entities.take(pa.array(order[first])), payloads.take(pa.array(order[first])), pa.array(at[first], pa.int32()), pa.array(at[end], pa.int32()), b.column("as_of").take(pa.array(began)), b.column("next_as_of").take(pa.array(ended))],
            names=["scope", "entity", "payload", "seq", "last", "as_of", "next_as_of"],
        )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions put together where one goes on in the next, from versions sorted by (scope, entity, seq); the open one is carried on."""
    held: pa.RecordBatch | None = None  # the open version
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        seq, last = b.column("seq").to_numpy(), b.column("last").to_numpy()
        payload = _codes(b.column("payload"))
        new = np.ones(b.num_rows, bool)
        new[1:] = (payload[1:] != payload[:-1]) | (seq[1:] - last[:-1] != 1)
        for c in KEYS:
            v = _codes(b.column(c))
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        end = np.append(first[1:], b.num_rows) - 1
        out = b.take(pa.array(first))
        for c in ("last", "next_as_of"):
            out = out.set_column(out.schema.get_field_index(c), c, b.column(c).take(pa.array(end)))
        held = out.slice(len(first) - 1)
        yield out.slice(0, len(first) - 1)
    if held is not None:
        yield held


def history(snapshots: DataFrame) -> DataFrame:
    """``scope, entity, payload, valid_from, valid_to``, one row a version, from standing snapshots.

    ``snapshots``: ``scope, block, seq, as_of, next_as_of, entries``, the last an array of structs ``entity, payload`` (texts); ``seq`` numbers the
    scope's snapshots, and the rows lie by (scope, block) as ``standing`` leaves them. An entity listed several times in a
    snapshot counts once, with the greatest payload (null is the least); null entities are left out. A version ends at
    ``next_as_of`` of its last snapshot, or is open (empty ``valid_to``) where the scope has no later one. A null payload is a
    value like any other. No snapshots give no rows.
    Work: a batch of snapshots is merged where it lies; only versions are exchanged, by (scope, entity), so a scope that holds
    most rows is spread over its entities.
    """
    entries = F.array_sort(F.filter("entries", lambda e: e["entity"].isNotNull()))
    last = F.filter(F.col("__e"), lambda e, i: F.coalesce(F.get(F.col("__e"), i + 1)["entity"] != e["entity"], F.lit(True)))
    sorted_ = snapshots.withColumn("__e", entries).withColumn("__e", last)
    sorted_ = sorted_.sortWithinPartitions("scope", "block", "seq")
    listed = sorted_.select("scope", F.col("seq").cast("int").alias("seq"), "as_of", "next_as_of", F.col("__e.entity").alias("entities"), F.col("__e.payload").alias("payloads"))
    versions = listed.mapInArrow(merged_versions, VERSION).repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
    out = versions.mapInArrow(_joined, VERSION)
    return out.select(*KEYS, "payload", day_text("as_of").alias("valid_from"), F.coalesce(day_text("next_as_of"), F.lit("")).alias("valid_to"))


def _entries(rows: DataFrame, entity: Callable[[Column], Column], payload: Callable[[Column], Column]) -> DataFrame:
    entry = F.transform("items", lambda e: F.struct(entity(e).alias("entity"), payload(e).alias("payload")))
    return rows.select("scope", "block", "seq", "as_of", "next_as_of", entry.alias("entries"))


def member_entries(snapshots: DataFrame) -> DataFrame:
    """Standing universe snapshots for ``history``; a member has no payload."""
    s = standing(snapshots, strip("index_name"), parse_day("as_of"), F.col("retrieved_at"), F.col("symbols"))
    return _entries(s, norm_symbol, lambda e: F.lit(None).cast("string"))


def file_entries(manifests: DataFrame) -> DataFrame:
    """Standing manifests for ``history``: the payload of a path is its hash."""
    s = standing(manifests, strip("store_name"), parse_day("universe_as_of"), F.col("published_at"), F.col("curated_files_sha256"))
    return _entries(s, lambda e: F.nullif(norm_path(e["key"]), F.lit("")), lambda e: norm_hash(e["value"]))


def membership_history(snapshots: DataFrame) -> DataFrame:
    """``index_name, symbol, valid_from, valid_to``: each unbroken stay of a member, from ``universe_snapshots``.

    Dates without a standing delivery are passed over; null and blank members are ignored; members respelled or
    listed twice count once. Empty input gives no rows.
    """
    h = history(member_entries(snapshots))
    return h.select(F.col("scope").alias("index_name"), F.col("entity").alias("symbol"), "valid_from", "valid_to")


def file_history(manifests: DataFrame) -> DataFrame:
    """``store_name, path, sha256, valid_from, valid_to``: each period in which a file had one content, from ``snapshot_manifests``."""
    h = history(file_entries(manifests))
    return h.select(F.col("scope").alias("store_name"), F.col("entity").alias("path"), F.col("payload").alias("sha256"), "valid_from", "valid_to")
