"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage reads what its predecessor kept; ``run`` writes every stage's result
as Parquet into the shared checkpoint folder and reads it again.  A stage may be
called by itself, so each one sees to the session's Arrow batches (``ship_package``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontaminate, packing, quality_fm, secrets, simhash
from corpusflow.llm.common import positional
from corpusflow.llm.queries import vocabulary
from corpusflow.session import ensure_checkpoint_dir, ship_package

#: Parts of words that a worker's encoder keeps: it shares an executor's memory with what the other stages left in the JVM.
CACHED_PARTS = 100_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    Null text counts as empty, rows without an id are judged like others, and
    repeated rows stay or go together.  Without training labels of both classes
    all documents stay.  No documents: none.
    """
    ship_package(spark)
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: that with the smallest id.

    Null and empty texts are one group; rows without an id link like others and
    come last in their group; of repeated rows one stays.  No documents: none.
    """
    ship_package(spark)
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay; rows are told apart by their
    text, so null and repeated ids cost no clean row.  No items: all stay.
    """
    ship_package(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and ``n_chars`` counted anew.

    Null texts stay null (``n_chars`` too); columns are found by exact name, so
    others may differ in case alone.  Repeated rows stay.  No documents: none.
    """
    ship_package(spark)
    clean, names = secrets.redact(docs), docs.columns
    if "n_chars" not in names:
        return clean
    rows, n = positional(clean), f"_in{names.index('n_chars')}"
    return rows.withColumn(n, F.length(f"_in{names.index('text')}").cast(dict(rows.dtypes)[n])).toDF(*names)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4,096 tokens.

    Null and empty texts are one end token; null ids pass through; repeated rows
    are packed each.  No documents: no pieces.
    """
    ship_package(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), cached_parts=CACHED_PARTS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: The stages train a model and compute tokens, which SQL cannot express; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
