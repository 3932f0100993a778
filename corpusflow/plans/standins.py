"""Stand-in inputs built from the driver's tables.

These only give rows in the schema the operators expect (an article table, a
window name, ...); none of them does an operator's work.  Each has a SQL twin
used by the oracle so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources.tables import table

# fixed values of the stand-in article table: title is the first
# line, the publish date is spread over 211 days from 2024-01-01.
DATE_ORIGIN = "2024-01-01"
DATE_SPREAD = 211


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, text, publish_date, lang, source, n_chars`` from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        "text",
        F.date_add(F.lit(DATE_ORIGIN).cast("date"),
                   F.pmod(F.col("doc_id") * F.col("doc_id"), F.lit(DATE_SPREAD)).cast("int")).alias("publish_date"),
        "lang", "source", "n_chars")


ARTICLES_SQL = f"""
articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text,
         CAST(DATE '{DATE_ORIGIN}' + CAST(((doc_id * doc_id) % {DATE_SPREAD}) AS INTEGER) AS DATE) AS publish_date,
         lang, source, n_chars
  FROM documents)"""


def embedded_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoder output (``embeddings``) with the attributes of the article of the same id.

    All embedding rows are one window (id 0); rows without an article keep a
    null title, which the pair step skips (P15).
    """
    attrs = articles(spark, sf_dir).select("id", "title", "publish_date", "text")
    return embedded_vectors(spark, sf_dir).join(attrs, "id", "left")


def embedded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vector, window_id`` from ``embeddings``; a column, not a literal, names the one window."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
        F.pmod(F.col("vec_id"), F.lit(1)).cast("long").alias("window_id"))


EMBEDDED_WINDOW_FILE = "all-sister-articles.jsonl"


def embedded_window_names(rows: DataFrame) -> DataFrame:
    """One file name per window present in ``rows``."""
    return rows.select("window_id").distinct().withColumn("file_name", F.lit(EMBEDDED_WINDOW_FILE))
