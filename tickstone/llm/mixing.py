"""Mixing sources to target weights by iterative proportional fitting.

Documents are measured in tokens and summed by cells of (source, language, topic). The cells' weights are raked in turn to the
marginals of topic, language and source, no weight above its source's passes, until they stand. A document of a
cell with weight w is taken floor(w) times, and once more with the probability that is left, so the mix has the
calibrated sizes in expectation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstone.functions.columns import norm_source, strip
from tickstone.llm.spread import spread
from tickstone.llm.subjects import Training, decode, fit, labelled, received, sent_model, subject_names
from tickstone.llm.tokens import DEFAULT, counter
from tickstone.session import cut

SIZED = "doc_id bigint, source string, lang string, topic string, tokens bigint"
CELL = ["source", "lang", "topic"]
MOST_CELLS = 200_000
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Raking:
    """``rounds`` of raking at most, fewer once no weight changes by more than ``tolerance`` of itself."""

    rounds: int = 500
    tolerance: float = 1e-9


def measured(documents: DataFrame, subjects: DataFrame, labels: DataFrame, tokenizer: str = DEFAULT, training: Training = Training(), training_on: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of every document; one pass over the texts.

    The classifier is fitted on the labelled documents of ``training_on`` (by default ``documents``).

    ``topic`` is the subject with the largest share by the classifier chain, ``none`` without one. A null or
    blank ``lang`` is ``und``; a null or blank ``source`` stays null. Null and blank texts have no tokens.
    """
    spark = documents.sparkSession
    names = subject_names(subjects)
    rows = labelled(documents if training_on is None else training_on, labels, training)
    sent = sent_model(spark, fit(rows, names, training) if names and len(rows) else None)
    lang = F.coalesce(F.nullif(F.lower(strip("lang")), F.lit("")), F.lit("und"))
    # ids travel as texts: pandas would turn a column with nulls into floats
    docs = spread(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", lang.alias("lang"), norm_source("source").alias("source")), "doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, sizes = received(sent.value), counter(tokenizer)
        for whole in batches:
            for a in range(0, len(whole), 1000):
                b = whole.iloc[a : a + 1000].reset_index(drop=True)
                topic = np.full(len(b), "none", object)
                if model:
                    label, share, _ = decode(model, b)
                    top = np.where(label > 0, share + 1, 0).argmax(axis=1)
                    topic = np.where(label.any(axis=1), np.array(model["names"], object)[top], "none")
                yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "topic": topic, "tokens": sizes([None if t is None or not t.strip() else t for t in b["text"]])})

    return docs.mapInPandas(run, SIZED.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _scaled(size: np.ndarray, weight: np.ndarray, cap: np.ndarray, group: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights times one factor a group, none above its cap, so that ``sum(size * weight)`` of each group meets its ``target`` if it can.

    ``group`` numbers the group of each cell. A group that cannot meet its target stands at its caps.
    """
    n = len(target)
    full = np.bincount(group, size * cap, minlength=n) <= target
    weight = np.where((size > 0) & (weight <= 0), 1e-12, weight)
    free = ~full[group] & (target > 0)[group]
    out = np.where(full[group], cap, 0.0)
    while free.any():
        left = target - np.bincount(group, np.where(free, 0.0, size * out), minlength=n)
        base = np.bincount(group, np.where(free, size * weight, 0.0), minlength=n)
        factor = np.divide(left, base, out=np.zeros(n), where=base > 0)
        scaled = weight * factor[group]
        over = free & (scaled > cap)
        out = np.where(free, np.minimum(scaled, cap), out)
        free &= ~over & np.isin(group, group[over])  # only groups with a new cell at its cap are scaled again
    return out


def rake(cells: pd.DataFrame, targets: pd.DataFrame, raking: Raking = Raking()) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Cells with ``weight``, and the sources' report, from cells' ``source, lang, topic, tokens`` and ``mix_targets``.

    The total is the size of the cells whose source has a target. Sources are raked to their share of it; languages and topics
    to their own shares of it, which the mix should keep. No weight exceeds ``max_passes``. A source is ``short`` if its raked
    weights stand at their caps and its tokens in the mix are still fewer than its share. The last step is the sources', so
    their shares hold exactly where they can be met; languages and topics follow as far as sources and passes allow. The
    report's ``rounds`` is the number of rounds made, ``moved`` the largest relative change of a weight in the last of them, and
    ``lang_off`` and ``topic_off`` are how far, at most, a language's and a topic's share of the mix is from its goal.
    """
    goal = targets.set_index("source")
    cells = cells[cells["source"].isin(goal.index)].sort_values(CELL).reset_index(drop=True)
    size = cells["tokens"].to_numpy(float)
    total = float(size.sum())
    source = goal.index.get_indexer(cells["source"])
    most = goal["max_passes"].to_numpy(float)
    want = goal["target_share"].to_numpy(float) * total
    own = np.bincount(source, size, minlength=len(goal))
    cap = most[source]
    reach = float(np.minimum(want, own * most).sum())
    code = {c: np.unique(cells[c].astype(str), return_inverse=True)[1] for c in ("topic", "lang")}
    margin = {c: np.bincount(g, size) / max(total, 1e-300) * reach for c, g in code.items()}
    steps = [(code[c], margin[c]) for c in ("topic", "lang")] + [(source, want)]
    weight = np.minimum(np.ones(len(size)), cap)
    rounds, moved = 0, 0.0
    while rounds < raking.rounds and len(size):
        before = weight
        for g, m in steps:
            weight = _scaled(size, weight, cap, g, m)
        rounds += 1
        moved = float(np.max(np.abs(weight - before) / np.maximum(before, 1e-12)))
        if moved <= raking.tolerance:
            break
    cells["weight"] = weight
    used = np.bincount(source, size * weight, minlength=len(goal))
    mixed = float(used.sum())
    at_cap = np.bincount(source, (weight < cap) & (size > 0), minlength=len(goal)) == 0
    off = {c: float(np.max(np.abs(np.bincount(g, size * weight) / mixed - np.bincount(g, size) / total))) if mixed else 0.0 for c, g in code.items()}
    report = pd.DataFrame({
        "source": goal.index, "target_share": goal["target_share"].to_numpy(float), "max_passes": goal["max_passes"].to_numpy("int32"), "own_tokens": own.astype("int64"), "mix_tokens": used,
        "share_of_total": used / total if total else 0.0 * used, "share_of_mix": used / mixed if mixed else 0.0 * used, "passes": np.divide(used, own, out=np.zeros(len(own)), where=own > 0),
        "short": at_cap & (want - used > 1e-12 * total), "rounds": np.int32(rounds), "moved": moved, "lang_off": off["lang"], "topic_off": off["topic"],
    })
    return cells, report


def _bounded(df: DataFrame, most: int, what: str) -> pd.DataFrame:
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def _goals(targets: DataFrame) -> pd.DataFrame:
    """Targets by normalised source; a source given twice has its shares added and its most passes."""
    t = targets.select(norm_source("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_passes", F.lit(1)).alias("max_passes"))
    t = t.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_passes").alias("max_passes"))
    return _bounded(t.orderBy("source"), MOST_SOURCES, "sources with a target")


def with_target(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows whose source, once it is spelled alike, has a target: no other takes part in a mix."""
    goals = rows.sparkSession.createDataFrame([(s,) for s in _goals(targets)["source"]], "__source string")
    return rows.join(F.broadcast(goals), norm_source("source") == F.col("__source"), "left_semi")


def calibrated(sized: DataFrame, targets: DataFrame, raking: Raking = Raking()) -> tuple[pd.DataFrame, pd.DataFrame]:
    """``rake`` of the documents' cells, which are summed where they lie. The driver holds a row a cell."""
    cells = with_target(sized, targets).groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
    return rake(_bounded(cells, MOST_CELLS, "cells of source, language and topic"), _goals(targets), raking)


def mix_report(sized: DataFrame, targets: DataFrame, raking: Raking = Raking()) -> DataFrame:
    """One row a source of ``targets``: shares aimed at and reached, passes used, and ``short`` where the passes do not suffice.

    ``share_of_total`` is of the size of all documents with a target, ``share_of_mix`` of the mix; the other columns are those of
    ``rake``. Without documents every share is zero and no source is short.
    """
    spark = sized.sparkSession
    kinds = "source string, target_share double, max_passes int, own_tokens bigint, mix_tokens double, share_of_total double, share_of_mix double, passes double, short boolean, rounds int, moved double, lang_off double, topic_off double"
    report = calibrated(sized, targets, raking)[1]
    return spark.createDataFrame(report if len(report) else [], kinds)


def mixed_sample(sized: DataFrame, targets: DataFrame, raking: Raking = Raking(), seed: int = 17) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, weight, copies``: the documents taken, with how often each is.

    The part of a weight below one is decided by a hash of ``doc_id`` and ``seed``, so the sample is the same at every run and needs no
    exchange; documents with the same ``doc_id`` are taken alike. ``sized`` is read twice and therefore kept as a checkpoint.
    """
    spark = sized.sparkSession
    kept = cut(sized)
    cells, _ = calibrated(kept, targets, raking)
    kinds = "source string, lang string, topic string, weight double"
    weights = spark.createDataFrame(cells[[*CELL, "weight"]] if len(cells) else [], kinds)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("weight")
    copies = (whole + F.when(chance < F.col("weight") - whole, 1).otherwise(0)).cast("int")
    # at most MOST_CELLS rows of weights: calibrated() has checked it
    return kept.join(F.broadcast(weights), CELL).withColumn("copies", copies).where("copies > 0").select("doc_id", *CELL, "tokens", "weight", "copies")


def reached(sample: DataFrame) -> DataFrame:
    """``source, documents, copies, tokens, share``: what a sample holds, by counting it."""
    by = sample.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    total: Sequence = by.agg(F.sum("tokens")).collect()
    return by.withColumn("share", F.try_divide(F.col("tokens").cast("double"), F.lit(float(total[0][0] or 0))))
