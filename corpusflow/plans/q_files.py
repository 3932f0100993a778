"""Round trips through files: mixture datasets, gz shards, article folders, the corpus file, the store, one shard; and the tokenizer's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators import bpe, mixture, pairs
from corpusflow.operators import calendar as C
from corpusflow.operators import store as S
from corpusflow.plans import q_communities, q_mixture, standins
from corpusflow.plans.q_store import A
from corpusflow.plans.registry import register
from corpusflow.session import cut_lineage, ensure_checkpoint_dir
from corpusflow.sources import files
from corpusflow.sources.tables import table

GZ_SHARDS = 4


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("mixture_files", f"""WITH {q_mixture._SAMPLES_SQL}, {q_mixture._CFG_SQL}
SELECT s.dataset, CAST(min(len(s.texts)) AS INTEGER) AS arity, count(*) AS "rows", CAST(max(cfg.weight) AS BIGINT) AS weight
FROM samples s JOIN cfg ON cfg.name = s.dataset GROUP BY s.dataset""")
def mixture_files(spark, sf_dir):
    """S13 + S15: datasets written as lines of JSON lists (one as objects) and the config as JSON, read back and checked."""
    path = _scratch(spark)
    smp = cut_lineage(q_mixture.samples(spark, sf_dir))
    config = cut_lineage(q_mixture._config(spark))
    names = sorted(r["name"] for r in config.collect())  # one per dataset of the mixture
    config.agg(F.to_json(F.collect_list(F.struct("name", "weight"))).alias("value")).coalesce(1).write.text(f"{path}/config")
    read = None
    for k, name in enumerate(names):
        texts = F.to_json("texts") if k else F.to_json(F.struct("texts"))
        smp.where(F.col("dataset") == name).select(texts.alias("value")).write.text(f"{path}/{name}")
        one = mixture.read_pair_dataset(spark, f"{path}/{name}", name)
        read = one if read is None else read.unionByName(one)
    return mixture.check_arity(read).join(mixture.read_mixture_config(spark, f"{path}/config").withColumnRenamed("name", "dataset"), "dataset") \
        .select("dataset", F.col("arity").cast("int").alias("arity"), "rows", "weight")


_DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@register("gz_shards", "SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM documents")
def gz_shards(spark, sf_dir):
    """Documents written as gz JSON under the manifest's shard names, scanned by the manifest, rows spread out."""
    path = _scratch(spark)
    shards = [r["name"] for r in files.c4_manifest(spark, f"{path}/", GZ_SHARDS).orderBy("shard").collect()]  # the names of the shards
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    for k, name in enumerate(shards):
        docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(GZ_SHARDS)) == k).write.option("compression", "gzip").json(name)
    read = files.read_gz_json(spark, shards, _DOC, partitions=8)
    return read.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@register("article_folders", f"""WITH {A}
SELECT strftime(publish_date, '%Y-%m') AS month, source AS archive, count(*) AS articles, CAST(sum(length(text)) AS BIGINT) AS chars
FROM articles GROUP BY ALL""")
def article_folders(spark, sf_dir):
    """Articles written as JSON lines in folders by month and archive, read back by folder."""
    path = _scratch(spark)
    a = standins.articles(spark, sf_dir).select("id", "title", "text", F.date_format("publish_date", "yyyy-MM").alias("month"), F.col("source").alias("archive"))
    files.write_articles(a, path)
    read = spark.read.schema("id long, title string, text string, month string, archive string").json(path)
    return read.groupBy("month", "archive").agg(F.count(F.lit(1)).alias("articles"), F.sum(F.length("text")).alias("chars"))


@register("corpus_records", f"""WITH RECURSIVE {q_communities._PAIRS_SQL}
SELECT input_text || '[start] ' || output_text || ' [end]' AS value FROM pairs""")
def corpus_records(spark, sf_dir):
    """The tokenizer's corpus file, records parted by a blank line, written and scanned again."""
    path = _scratch(spark)
    files.write_corpus(files.corpus_lines(q_communities._pairs(spark, sf_dir)), path)
    return spark.read.option("lineSep", "\n\n").text(path).select("value")


@register("store_appends", """WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT DISTINCT text FROM documents)
SELECT CAST(1 AS BIGINT) AS step, (SELECT count(*) FROM a) AS added UNION ALL
SELECT 2, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) UNION ALL SELECT 3, 0""")
def store_appends(spark, sf_dir):
    """S6 + P16: half of the documents, then all, then all again appended to the store; rows that each step added."""
    path = _scratch(spark)
    a = standins.articles(spark, sf_dir)
    rows = cut_lineage(S.store_projection(a.withColumn("status", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))))
    half = rows.where("status = 'even'")
    order = ["publish_date", "title"]
    added = [S.append_unique(spark, path, x, order_by=order) for x in (half, rows, rows)]
    return spark.createDataFrame(list(enumerate(added, 1)), "step long, added long")


@register("first_shard", f"""WITH RECURSIVE {q_communities._PAIRS_SQL}
SELECT input_text, output_text, output_text_score, file_path FROM pairs
QUALIFY row_number() OVER (ORDER BY cluster_no, member_no) <= 100""")
def first_shard(spark, sf_dir):
    """The rows of one shard of 100 examples, streamed in order."""
    path = _scratch(spark)
    files.write_shards(pairs.assign_shards(q_communities._pairs(spark, sf_dir), examples_per=100), path)
    rows = [(r["input_text"], r["output_text"], r["output_text_score"], r["file_path"]) for r in files.iter_shard(spark, path, 0)]  # 100 at most
    return spark.createDataFrame(rows, "input_text string, output_text string, output_text_score float, file_path string")


@register("title_keys", f"""WITH {A}
SELECT id, split_part(title || ' -- ', ' -- ', 1) AS title FROM articles WHERE title IS NOT NULL AND text IS NOT NULL""")
def title_keys(spark, sf_dir):
    """F8 + F9: the title taken back out of each article's dedup key."""
    a = standins.articles(spark, sf_dir).where("title is not null and text is not null")
    return a.select("id", C.key_title(C.dedup_key("title", "text")).alias("title"))


@register("word_totals", "SELECT count(text) AS lines, CAST(0 AS BIGINT) AS bytes_lost FROM documents")
def word_totals(spark, sf_dir):
    """A10 + F12: the counted words hold every byte of the normalised texts, and the space before each."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("line")).where("line is not null")
    zero = F.lit(0).cast("long")
    held = bpe.word_counts(docs).agg((-F.sum(F.col("n") * F.length("word"))).alias("bytes")).select(zero.alias("lines"), "bytes")
    there = docs.select(bpe.nfkc(F.col("line")).alias("t")).agg(F.count(F.lit(1)).alias("lines"), F.sum(
        F.octet_length("t") + F.when(F.startswith("t", F.lit(" ")), 0).otherwise(1)).alias("bytes"))
    return there.unionByName(held).agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes_lost"))


@register("decoded_texts", "SELECT doc_id, true AS round_trip FROM documents")
def decoded_texts(spark, sf_dir):
    """B1 -> B2 -> B3: a vocabulary of 400 trained on all documents, every document encoded and decoded: its normalised text comes back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocab, merges = bpe.train_bpe(bpe.word_counts(docs.where("text is not null").select(F.col("text").alias("line"))), vocab_size=400)
    ids = bpe.encode_texts(docs, ["doc_id", "text"], "text", vocab, merges)
    back = bpe.decode_ids(ids.withColumnRenamed("text", "given"), "ids", vocab, ["doc_id", "given"])
    plain = bpe.nfkc(F.coalesce("given", F.lit("")))
    return back.withColumn("plain", plain).select("doc_id", (F.col("text") == F.when(F.startswith("plain", F.lit(" ")), F.col("plain")).otherwise(
        F.concat(F.lit(" "), F.col("plain")))).alias("round_trip"))
