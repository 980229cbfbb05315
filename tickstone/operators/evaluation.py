"""Chronological splits by label availability, metrics, and a boosted-tree baseline."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstone.operators.features import FEATURES


def split(features: DataFrame, train_end: Column, eval_start: Column, tick: Column, order: str = "session") -> tuple[DataFrame, DataFrame]:
    """Train: labels known at ``train_end``. Evaluation: from ``eval_start`` on with labels known at ``tick``. Rows between are in neither."""
    train = features.where(F.col("target_available_at") <= train_end)
    held = features.where((F.col(order) >= eval_start) & (F.col("target_available_at") <= tick))
    return train, held


def metrics(rows: DataFrame, predicted: str = "prediction", actual: str = "target_return") -> DataFrame:
    """One row ``n, rmse, zero_rmse, correlation``; the correlation is 0 where either side is constant.

    Written with covariance and deviations, as ``corr`` raises on constant input under ANSI arithmetic.
    """
    p, a = F.col(predicted).cast("double"), F.col(actual).cast("double")
    both = rows.where(p.isNotNull() & a.isNotNull())
    spread = F.stddev_pop(p) * F.stddev_pop(a)
    return both.agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg((p - a) * (p - a))).alias("rmse"),
        F.sqrt(F.avg(a * a)).alias("zero_rmse"),
        F.coalesce(F.try_divide(F.covar_pop(p, a), spread), F.lit(0.0)).alias("correlation"),
    )


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip").transform(rows)


def train_baseline(train: DataFrame, seed: int = 17, iterations: int = 80, depth: int = 4) -> GBTRegressionModel:
    """Gradient-boosted trees on the features; no rows is an error. Level-wise trees, so not equal to leaf-wise ones."""
    if not train.limit(1).count():
        raise ValueError("no training rows")
    gbt = GBTRegressor(featuresCol="features", labelCol="target_return", maxIter=iterations, maxDepth=depth, maxBins=255, stepSize=0.1, seed=seed)
    return gbt.fit(_vectors(train))


def predict(model: GBTRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(_vectors(rows)).drop("features")
