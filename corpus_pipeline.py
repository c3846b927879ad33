"""From raw documents to packed sequences: toxicity, exact and near copies, mixing, packing."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lamella.llm.common import documents, labels, scratch_path, temporary, tokenizer_path

#: Target shares of the two quality domains; no document's rate falls below 1, so none is lost.
WEIGHTS = {"high": 0.92, "low": 0.08}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose restored text scores 0.5 or more."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels(spark, sf_dir)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    return exact_dedup.drop_copies(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least doc_id of each class of near-duplicates."""
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by fitted rates of at least 1, towards the target shares."""
    model = mixing.fit_classifier(docs, labels(spark, sf_dir), mixing.by_quality(), list(WEIGHTS))
    rows = mixing.scored(model, docs)
    return mixing.realised(mixing.fit_rates(model, rows, WEIGHTS, least_rate=1.0, grow=True), rows)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' ids into sequences of at most 4096."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the scores nor the classes nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again, and its own tables dropped."""
    docs = documents(spark, sf_dir)
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
