"""Spreading rows over the cores before work in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with at least two parts a core: too few files (or too large ones) would leave cores idle.

    By hash of ``keys``, so that a part made again after a loss holds the same rows. Where the input has enough parts,
    nothing is moved.
    """
    least = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least, *keys)
