"""A corpus pipeline of five stages, each over all that the stage before kept.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents.  The learned stages read
``labels`` and the decontamination ``benchmark`` in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.decision_list import keep_passing
from paperloom.llm.decontamination import drop_leaks
from paperloom.llm.kernel_quality import keep_good
from paperloom.llm.near_duplicates import keep_first
from paperloom.llm.queries import KEEP_FROM, round_trip
from paperloom.sources.sinks import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and no learned rule rejects."""
    return keep_passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a kernel score of at least the operator's threshold."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), KEEP_FROM)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group of near-duplicates: five words, similarity 0.8."""
    return keep_first(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    return round_trip(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", encode),
]

# Fitted rules and scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
