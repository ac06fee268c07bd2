"""Corpus preparation in five stages, each written as Parquet and read again as the next one's documents.

Stages take (spark, docs, sf_dir). All but the last give the columns of ``documents``: the quality
classifier drops what it rejects, SimHash near-deduplication leaves one document of each group,
decontamination drops documents with benchmark windows, and personal data is replaced by marks. The
last packs what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopyframe.llm import classifier, decontaminate, packing, pii, simhash
from canopyframe.llm.registry import table
from canopyframe.plans.lineage import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-deduplication", near_duplicates),
    ("decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("packing", sequences),
]

#: Fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
