"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, group_packing, hard_negatives, licenses, packing, quality_fm, quality_rules, secrets, simhash, token_counts, toxicity, warc,
               whitening)
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their exact containment."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def sample_edits(docs: DataFrame) -> DataFrame:
    """Stand-in edits, three per document: places, lengths and inserted words from hashes of the id."""
    h = lambda k: F.xxhash64("doc_id", "seq", F.lit(k))
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    rows = docs.select("doc_id", n.alias("n"), F.substring("text", 1, 40).alias("own"), F.explode(F.array(*map(F.lit, range(3)))).alias("seq"))
    return rows.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.pmod(h(1), F.col("n") + 1).alias("start"),
                       F.pmod(h(2), F.lit(60)).alias("n_delete"), F.when(F.pmod(h(3), F.lit(4)) > 0, F.col("own")).otherwise("").alias("insert"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents after three edits each."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts.count_edited(docs, sample_edits(docs), vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the anchors whose id is divisible by 100; labels of ids divisible by 7 are moved by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(moved, F.col("id") % 100 == 0, id_col="vec_id", vector_col="embedding", scale=256)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), id_col="vec_id", vector_col="embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_token_counts, op4_quality_rules, op5_warc,
                            op6_secrets, op7_packing, op8_quality, op9_simhash, op10_licenses, op11_hard_negatives,
                            op12_packing, op13_whitening)}
ORACLE: dict[str, str] = {"op1_decontamination": decontaminate.SQL, "op4_quality_rules": quality_rules.oracle_sql(), "op5_warc": warc.SQL,
                          "op11_hard_negatives": hard_negatives.SQL}
