"""Tokenizer queries (F12, A10, B1-B3, S12); SQL cannot express the pre-tokeniser, so rows-only checks
here and exact equality with the reference trainer in tests/test_bpe.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import bpe
from corpusflow.plans import q_communities
from corpusflow.plans.registry import register
from corpusflow.session import cut_lineage
from corpusflow.sources import files
from corpusflow.sources.tables import table


@register("word_counts")
def word_counts(spark, sf_dir):
    """NFKC + byte-level pre-tokenised word frequencies over every document (whole texts)."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("line"))
    return bpe.word_counts(docs)


def _trained(pairs):
    return bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(files.corpus_lines(pairs))))


@register("bpe_merges")
def bpe_merges(spark, sf_dir):
    """B1: byte-level BPE (vocabulary 5000, min pair frequency 2) trained on the sister-pair corpus."""
    _, merges = _trained(q_communities.sister_pairs(spark, sf_dir))
    return merges


@register("bpe_encode")
def bpe_encode(spark, sf_dir):
    """B2 + B3: every training pair encoded with the trained merges, decoded back, round trip checked."""
    pairs = cut_lineage(q_communities.sister_pairs(spark, sf_dir))
    vocab, merges = _trained(pairs)
    enc_in = bpe.encode_texts(pairs, ["file_path"], "input_text", vocab, merges).withColumnRenamed("ids", "input_ids")
    enc_out = bpe.encode_texts(pairs, ["file_path"], "output_text", vocab, merges).withColumnRenamed("ids", "output_ids")
    dec = bpe.decode_ids(enc_out, "output_ids", vocab, ["file_path"]).withColumnRenamed("text", "decoded")
    out = pairs.join(enc_in, "file_path").join(enc_out, "file_path").join(dec, "file_path")
    return out.select("file_path", F.size("input_ids").cast("long").alias("input_tokens"),
                      F.size("output_ids").cast("long").alias("output_tokens"),
                      (F.ltrim("decoded") == F.ltrim(bpe.nfkc(F.col("output_text")))).alias("round_trip"))


@register("bpe_pair_counts")
def bpe_pair_counts(spark, sf_dir):
    """B1 first round: adjacent byte-symbol pair counts, weighted by word frequency, over every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("line"))
    return bpe.pair_counts(bpe.word_counts(docs))
