"""Queries of the text operators over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickstone.llm.leakage import leaks, without_leaks
from tickstone.llm.mixing import measured, mix_report, mixed_sample, reached, with_target
from tickstone.llm.subjects import composition, labelled, subjects_of
from tickstone.sources.tables import table


def p6_matches(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_matches(spark, d).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents"), p6_found(spark, d)).select("doc_id", "source", "n_chars")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return measured(with_target(documents, table(spark, d, "mix_targets")), table(spark, d, "subjects"), table(spark, d, "doc_labels"), training_on=documents)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_report(_measured(spark, d), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).where("short").select("source")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return mixed_sample(_measured(spark, d), table(spark, d, "mix_targets"))


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    return reached(p7_sample(spark, d))


def p8_labelled(spark: SparkSession, d: str) -> DataFrame:
    """The labels that the classifier is fitted on, by document."""
    rows = labelled(table(spark, d, "documents"), table(spark, d, "doc_labels"))
    return spark.createDataFrame([(int(i), ",".join(x)) for i, x in zip(rows["doc_id"], rows["labels"], strict=True)], "doc_id bigint, labels string")


def p8_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects_of(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "doc_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return composition(p8_found(spark, d), table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p6_matches, p6_found, p6_clean, p7_shares, p7_found, p7_sample, p7_reached, p8_labelled, p8_subjects, p8_found, p8_composition)
}

BLANKS = "chr(32)||chr(9)||chr(10)||chr(13)||chr(12)||chr(11)||chr(160)"
SOURCE = "nullif(lower(replace(trim({0}, " + BLANKS + "), ' ', '_')), '')"
# no case depends on the tokenizer, so characters serve as sizes here
SQL: dict[str, str] = {
    "p8_labelled": f"""
SELECT l.doc_id, string_agg(DISTINCT lower(trim(l.subject, {BLANKS})), ',' ORDER BY lower(trim(l.subject, {BLANKS}))) AS labels
FROM doc_labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.subject IS NOT NULL AND d.text IS NOT NULL GROUP BY l.doc_id""",
    "p7_found": f"""
WITH sizes AS (SELECT {SOURCE.format("source")} AS source, sum(length(text)) AS size FROM documents WHERE trim(text, {BLANKS}) <> '' GROUP BY 1),
goals AS (SELECT {SOURCE.format("source")} AS source, target_share, max_passes FROM mix_targets),
own AS (SELECT g.*, coalesce(s.size, 0) AS size FROM goals g LEFT JOIN sizes s ON s.source = g.source)
SELECT source FROM own WHERE max_passes * size < target_share * (SELECT sum(size) FROM own)""",
}
