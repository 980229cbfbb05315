"""Queries of the data-preparation operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstone.operators.history import file_history, membership_history
from tickstone.operators.outliers import implausible, outlier_report
from tickstone.operators.regular_grid import regular_grid
from tickstone.operators.rolling import activity_marks, rolling_totals
from tickstone.operators.snapshot_diff import delivery_changes
from tickstone.sources.tables import table


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "pit_bars"), table(spark, d, "exchange_sessions"))


def p1_observed(spark: SparkSession, d: str) -> DataFrame:
    """The part of the grid that is not estimated."""
    return p1_grid(spark, d).where("not filled").select("symbol", "session_date", "value", "n_readings")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("filled and value is not null").select("symbol", "session_date")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return membership_history(table(spark, d, "universe_snapshots"))


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    return file_history(table(spark, d, "snapshot_manifests"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return outlier_report(table(spark, d, "pit_bars"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return implausible(table(spark, d, "pit_bars")).select("symbol", "event_us", "field")


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    return delivery_changes(table(spark, d, "universe_snapshots"), table(spark, d, "snapshot_manifests")).selectExpr("scope", "as_of", "item", "change", "array_join(fields, ',') AS fields")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_changes(spark, d).drop("fields")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(table(spark, d, "pit_bars"))


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    # sums in whole ten-thousandths, the prices' last digit: free of the sums' order
    sums = {f"close_sum_{n}": F.round(f"close_sum_{n}", 4) for n in (7, 30)}
    averages = {f"close_avg_{n}": F.try_divide(F.col(f"close_sum_{n}"), F.col(f"close_n_{n}").cast("double")) for n in (7, 30)}
    return _totals(spark, d).withColumns(sums).withColumns(averages)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return activity_marks(_totals(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_grid, p1_observed, p1_found, p2_found, p2_versions, p3_report, p3_found, p4_changes, p4_found, p5_totals, p5_found)
}
