"""Files in and out: as-of CSV, raw bars by symbol, holdings with a preamble, universe JSON, hashes, snapshots, run cards."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstone.functions.columns import norm_symbol, parse_day, strip
from tickstone.schemas import CSV_BAR, RAW_BAR, UNIVERSE, struct
from tickstone.sources.atomic import write_text
from tickstone.sources.calendar import weekdays
from tickstone.sources.pit_store import aware
from tickstone.sources.storage import Storage


class BarSource(Protocol):
    """Anything that gives the bars visible at a time, and the number of those left out."""

    def load_as_of(self, as_of: datetime) -> tuple[DataFrame, int]: ...


class CsvBars:
    """A CSV of ``symbol, session, available_at, close`` with header."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        raw = self.spark.read.schema(CSV_BAR).csv(self.path, header=True)
        return raw.select("symbol", F.to_date("session", "yyyy-MM-dd").alias("session"), F.col("available_at").cast("timestamp").alias("available_at"), "close")

    def load_as_of(self, as_of: datetime) -> tuple[DataFrame, int]:
        """Rows available at ``as_of`` by symbol and session, and how many are not; a null time is never available."""
        at = F.lit(aware(as_of, "as_of"))
        df = self.frame()
        hidden = df.select(F.count_if(F.coalesce(F.col("available_at") > at, F.lit(True)))).first()[0]
        return df.where(F.col("available_at") <= at).orderBy("symbol", "session"), hidden


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def raw_bars(spark: SparkSession, folder: str, symbols: Sequence[str], start: date | None = None, end: date | None = None) -> tuple[DataFrame, list[str]]:
    """One scan of ``folder/<symbol>.parquet`` over the symbols that have a file, and the symbols that have none.

    ``start <= ts < end`` in UTC dates, written on ``ts`` itself so that the scan can skip row groups; by ts.
    """
    named = set(Storage(spark).names(folder))
    there = [s for s in symbols if f"{s}.parquet" in named]
    absent = [s for s in symbols if f"{s}.parquet" not in named]
    paths = [f"{folder.rstrip('/')}/{s}.parquet" for s in there]
    df = spark.read.schema(struct(RAW_BAR)).parquet(*paths) if paths else spark.createDataFrame([], struct(RAW_BAR))
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(f"{start.isoformat()} 00:00:00+00:00").cast("timestamp"))
    if end is not None:
        df = df.where(F.col("ts") < F.lit(f"{end.isoformat()} 00:00:00+00:00").cast("timestamp"))
    return df.orderBy("ts"), absent


def universe_members(spark: SparkSession, path: str) -> DataFrame:
    """``symbol`` of a universe JSON file, each once, sorted."""
    df = spark.read.schema(struct(UNIVERSE)).json(path, multiLine=True)
    return df.select(F.explode("symbols").alias("symbol")).distinct().orderBy("symbol")


def distinct_symbols(rows: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``symbol``: each once, spelled alike; null and blank ones are left out."""
    return rows.select(norm_symbol(symbol).alias("symbol")).where("symbol is not null").distinct()


# Exchanges of a listed share, and how the date line and the header of a holdings file begin.
EXCHANGES = ("NASDAQ", "NYSE")
AS_OF_LINE, HEADER_START = "Fund Holdings as of", "Ticker,Name,"


def holdings(spark: SparkSession, text: str, exchanges: Sequence[str] | None = EXCHANGES, asset_class: str = "Equity", location: str = "United States") -> tuple[date, DataFrame]:
    """The date and the sorted distinct symbols of a holdings file: free lines, a line with the date, a header, rows.

    Rows count if ``Asset Class`` and ``Location`` are the given ones, the ``Exchange`` is listed (None: any) and the ticker is not
    blank. A file without date line, header or counting rows is refused. The preamble is read on the driver, the rows by Spark.
    """
    lines = text.lstrip("﻿").splitlines()
    dated = next((x for x in lines if x.startswith(AS_OF_LINE)), None)
    if dated is None:
        raise ValueError("holdings have no as-of line")
    head = next((i for i, x in enumerate(lines) if x.startswith(HEADER_START)), None)
    if head is None:
        raise ValueError("holdings have no header")
    spelled = dated[len(AS_OF_LINE) :].strip(' ,"')
    at = spark.range(1).select(parse_day(F.lit(spelled))).first()[0]
    if at is None:
        raise ValueError(f"holdings have an unreadable date: {spelled}")
    rows = spark.createDataFrame([(x,) for x in lines[head:] if x.strip()], "value string")
    names = [c.strip().strip('"') for c in lines[head].split(",")]
    kinds = ", ".join(f"`{c}` string" for c in names)
    df = rows.where(F.col("value") != lines[head]).select(F.from_csv("value", kinds).alias("r")).select("r.*")
    keep = (F.col("Asset Class") == asset_class) & (F.col("Location") == location) & (strip("Ticker") != "")
    if exchanges is not None:
        keep &= F.col("Exchange").isin(list(exchanges))
    out = distinct_symbols(df.where(keep), "Ticker").orderBy("symbol")
    if not out.limit(1).count():
        raise ValueError("holdings have no counting rows")
    return at, out


def write_universe(path: Path | str, index: str, proxy: str, as_of: date, retrieved_at: datetime, symbols: Iterable[str], url: str = "", note: str = "") -> None:
    listed = sorted(set(symbols))
    body = {"index": index, "proxy": proxy, "as_of": as_of.isoformat(), "retrieved_at": aware(retrieved_at).isoformat(), "source_url": url, "source_note": note, "symbols": listed, "symbol_count": len(listed)}
    Storage().write(path, (json.dumps(body, indent=2) + "\n").encode())


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of the files under ``path``, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def publish(root: Path | str, files: Mapping[str, Path | str], manifest: Mapping[str, Any], hashes: Mapping[str, str], spark: SparkSession | None = None) -> str:
    """Publish a snapshot named by the hash of its manifest; returns the name.

    The files are copied under ``root/snapshots/<name>``, each as a whole or not at all, and checked against ``hashes``; a file that is
    there with other content is an error. The manifest is written, then the pointer ``current.json``, so a reader sees the old or
    the new one. All paths may lie on any storage.
    """
    storage, text = Storage(spark), canonical(dict(manifest))
    name = hashlib.sha256(text.encode()).hexdigest()
    target = f"{root}/snapshots/{name}"
    for rel, source in files.items():
        to = f"{target}/{rel}"
        if not storage.exists(to):
            storage.copy(source, to)
        if storage.sha256(to) != hashes[rel]:
            raise ValueError(f"snapshot file {rel} has other content")
    storage.write(f"{target}/manifest.json", text.encode())
    storage.write(f"{root}/current.json", json.dumps({"snapshot_id": name}).encode())
    return name


def write_card(path: Path, card: Mapping[str, Any]) -> None:
    write_text(path, json.dumps(dict(card), indent=2, sort_keys=True, default=str) + "\n")


def synthetic_bars(spark: SparkSession, symbols: Sequence[str] = ("AAA", "BBB", "CCC", "DDD", "EEE"), start: date = date(2020, 1, 1), end: date = date(2023, 7, 14), seed: int = 13) -> DataFrame:
    """A repeatable panel of closes with momentum on weekdays, available at 21:00 UTC: ``symbol, session, available_at, close``."""
    rng = random.Random(seed)
    rows = []
    for i, s in enumerate(symbols):
        price, past = 50.0 + 10 * i, [0.0]
        for d in weekdays(start, end):
            recent = past[-5:]
            r = 0.25 * sum(recent) / len(recent) + rng.gauss(0.0003, 0.011)
            past.append(r)
            price *= math.exp(r)
            rows.append((s, d, datetime.fromisoformat(f"{d}T21:00:00+00:00"), round(price, 6)))
    return spark.createDataFrame(rows, "symbol string, session date, available_at timestamp, close double")
