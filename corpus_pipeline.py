"""A training corpus from documents, in stages: each is written and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, near_dedup, pii, sentencepiece_codec, toxicity
from loomgraph.llm.shared import AT, FILE, drop_path, filter_rows, scratch, shared_path, table, with_row_ids, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearest labelled examples do not call toxic; null texts stay."""
    scored = toxicity.score_column(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), prefix="_toxicity_")
    return scored.where("_toxicity_predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id."""
    numbered = with_row_ids(docs, [])
    kept = near_dedup.classes(numbered).where("keep")
    return filter_rows(docs, numbered, kept, "kept-rows", keep=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; DataFrame operations only, like the operator."""
    numbered = with_row_ids(docs, [])
    found = decontaminate.contaminated(numbered, table(spark, sf_dir, "benchmark"))
    found = written(found.select(FILE, AT).distinct(), "leak-rows")
    return numbered.join(found, [FILE, AT], "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data in their texts replaced by its kind."""
    return pii.redact_column(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the counts and digests of its ids and of the text that they decode to."""
    return sentencepiece_codec.codec_digests(docs, sentencepiece_codec.default_model())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode),
]

#: SQL expresses neither the scores nor the signatures; tests/llm holds a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of what they write, only the last one's rows stay."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
