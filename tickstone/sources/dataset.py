"""Build a point-in-time dataset from raw daily bars and publish it as an immutable snapshot."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstone.operators.bars import daily_to_pit
from tickstone.sources.files import file_hashes, publish, raw_bars, universe_members
from tickstone.sources.pit_store import PitStore
from tickstone.sources.storage import Storage


@dataclass(frozen=True)
class Built:
    snapshot_id: str
    inserted: int
    absent: list[str]


def _hashes(spark: SparkSession, folder: str) -> dict[str, str]:
    """Hash of each Parquet file below ``folder`` by its relative path, made where the files are read. A dataset's list of files is held by the driver."""
    storage = Storage(spark)
    if not storage.names(folder):
        return {}
    rows = file_hashes(spark, folder).where(F.col("path").endswith(".parquet")).collect()
    return {storage.inside(folder, r.path): r.sha256 for r in rows}


def build_dataset(spark: SparkSession, universe: Path | str, raw_folder: str, store_root: str, out: Path | str, sessions: DataFrame, start: date, end: date, vendor_delay: timedelta = timedelta(minutes=15), source: str = "") -> Built:
    """Raw bars of the universe's symbols with ``start <= ts < end`` into the store, then a snapshot of the store.

    All symbols are one scan and one append. The manifest names the universe, the range, the ``source`` of the bars, the hashes of all files read and stored, the
    coverage and the symbols without a file; its hash is the snapshot's name, so the same data gives the same name. The
    snapshot's ``bars`` folder is a store itself.
    """
    if start >= end:
        raise ValueError("start must be before end")
    symbols = [r.symbol for r in universe_members(spark, str(universe)).collect()]  # a universe's list of names
    raw, absent = raw_bars(spark, raw_folder, symbols, start, end)
    store = PitStore(spark, store_root)
    inserted = store.write(daily_to_pit(raw, sessions, vendor_delay))
    listed = Storage(spark).read(universe)
    named = json.loads(listed)
    sources: dict[str, list[str]] = {}
    for path, digest in sorted(_hashes(spark, raw_folder).items()):
        sources.setdefault(path.split("/")[0].removesuffix(".parquet"), []).append(digest)
    stored = {f"bars/{p}": h for p, h in _hashes(spark, store_root).items()}
    seen = store.coverage().select("rows", "symbols", F.date_format("first", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("first_event_time"), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("last_event_time")).first()
    manifest = {
        "schema_version": 1,
        "universe_as_of": named.get("as_of"),
        "universe_source_url": named.get("source_url"),
        "universe_sha256": hashlib.sha256(listed).hexdigest(),
        "requested_symbols": symbols,
        "requested_start": start.isoformat(),
        "requested_end_exclusive": end.isoformat(),
        "source": source,
        "available_at_rule": f"session close + {vendor_delay.total_seconds() / 60:g} minutes",
        "corporate_action_adjustment": None,
        "source_bar_file_sha256": {s: h[0] if len(h) == 1 else hashlib.sha256("".join(h).encode()).hexdigest() for s, h in sources.items() if s in set(symbols)},
        "curated_files_sha256": stored,
        "coverage": seen.asDict(),
        "symbols_without_raw_files": absent,
    }
    files = {p: f"{store_root.rstrip('/')}/{p.removeprefix('bars/')}" for p in stored}
    return Built(publish(out, files, manifest, stored, spark), inserted, absent)
