"""Session settings, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tickstone", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; ``conf`` keys use ``__`` for a dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local master (tests) gets a temporary one, removed when Python ends; on a cluster without the setting this raises,
    since a machine-local folder would not outlive its executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tickstone-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder, for tables that a later step reads."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in ``shared_folder``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if a count of at most ``max_rows + 1`` rows shows that it is small, else ``df`` as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
