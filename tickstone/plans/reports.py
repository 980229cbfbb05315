"""What runs leave behind: payloads by content, a report of the event log, a registry of results, checks of scored texts."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickstone.plans.flow import frame_digest
from tickstone.sources.storage import Storage

REGISTRY = "run_id string, at timestamp, name string, params map<string,string>, metrics map<string,double>"


def store_payload(df: DataFrame, root: str) -> str:
    """Write ``df`` as Parquet under its digest, unless it is there; returns the path. Equal rows share one path."""
    path = f"{root.rstrip('/')}/{frame_digest(df)}"
    if not Storage(df.sparkSession).exists(f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return path


def run_report(log: DataFrame) -> DataFrame:
    """``run_id, tick, nodes, ok, missing, failed, retries, duration_ms, slowest``: one row a run and tick of an event log.

    Rows without run or tick are left out; ``slowest`` is the node with the longest time, by name among equals.
    """
    kind = F.col("event")
    done = kind == "node_completed"
    rows = log.where("run_id is not null and tick is not null")
    return rows.groupBy("run_id", "tick").agg(
        F.count_distinct("node").alias("nodes"),
        F.count_if(done & (F.col("status") == "ok")).alias("ok"),
        F.count_if(done & (F.col("status") == "missing")).alias("missing"),
        F.count_if(kind == "node_failed").alias("failed"),
        F.count_if(kind == "node_retried").alias("retries"),
        F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("duration_ms"),
        F.min_by("node", F.when(F.col("duration_ms").isNotNull(), F.struct(-F.col("duration_ms"), F.col("node")))).alias("slowest"),
    )


class Registry:
    """Results of runs, appended to a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, run_id: str, name: str, params: dict[str, str], metrics: dict[str, float], at: datetime | None = None) -> None:
        row = (run_id, at or datetime.now(UTC), name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})
        self.spark.createDataFrame([row], REGISTRY).write.mode("append").parquet(self.path)

    def best(self, metric: str, highest: bool = False) -> DataFrame:
        """The best run of each name; runs without a finite value of the metric do not compete, ties go to the earlier run."""
        value = F.col("metrics").getItem(metric)
        rows = self.spark.read.schema(REGISTRY).parquet(self.path).withColumn("value", value).where("value is not null and not isnan(value)")
        order = [F.desc("value") if highest else F.asc("value"), "at", "run_id"]
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where("k = 1").drop("k")


def checked_scores(answers: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``answers`` (``answer`` JSON text, ``source`` text) with ``score``, ``evidence`` and ``problem``.

    ``problem`` is ``format`` (no JSON object with a score and evidence), ``range`` (score outside ``low..high`` or NaN), ``evidence`` (not
    word for word in the source), else null. Null answers have the wrong format; nothing is in a null source.
    """
    parsed = F.from_json("answer", "score double, evidence string")
    rows = answers.withColumn("__p", parsed).withColumns({"score": F.col("__p.score"), "evidence": F.col("__p.evidence")}).drop("__p")
    absent = F.col("score").isNull() | F.col("evidence").isNull() | (F.col("evidence") == "")
    problem: Column = F.when(absent, "format").when(~F.col("score").between(low, high), "range").when(~F.coalesce(F.contains("source", "evidence"), F.lit(False)), "evidence")
    return rows.withColumn("problem", problem)


def one_of_ranking(scores: DataFrame, symbol: str, tick: str = "tick") -> DataFrame:
    """``symbol``'s rank among all symbols of each tick, the highest score first, null scores last; ties go by symbol.

    Ranks by counting who is ahead, in partial sums: no tick is sorted or gathered. A symbol given twice in a tick is ranked at its best.
    """
    own = scores.where(F.col("symbol") == symbol).groupBy(tick).agg(F.max("score").alias("__own"))
    score, mine = F.col("score"), F.col("__own")
    higher = F.coalesce(score > mine, score.isNotNull() & mine.isNull())
    ahead = higher | (score.eqNullSafe(mine) & (F.col("symbol") < symbol))
    met = scores.join(own.withColumnRenamed(tick, "__tick"), F.col(tick).eqNullSafe(F.col("__tick")))
    counted = met.groupBy(tick, "__own").agg((F.count_if(ahead) + 1).cast("int").alias("rank"), F.count("*").alias("of"))
    return counted.select(tick, F.lit(symbol).alias("symbol"), F.col("__own").alias("score"), "rank", "of")
