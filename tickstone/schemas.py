"""Schemas of the tables. Column order is part of the contract; all times are UTC with microseconds."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, vwap double, trade_count bigint"
PIT_BAR = "symbol string, event_time timestamp, available_at timestamp, open double, high double, low double, close double, volume double, vwap double, adj_factor double"
CSV_BAR = "symbol string, session string, available_at string, close double"
UNIVERSE = "`index` string, proxy string, as_of string, retrieved_at string, source_url string, source_note string, symbols array<string>, symbol_count int"
EVENT = (
    "event string, run_id string, tick string, node string, attempt int, node_version string, status string, duration_ms double,"
    " inputs map<string,string>, output string, error string, detail string, node_count int, outputs int"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def columns(ddl: str) -> list[str]:
    return struct(ddl).names
