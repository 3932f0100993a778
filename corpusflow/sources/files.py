"""File sources and sinks: JSONL scans, article sink, manifests, training shards, tokenizer corpus.

S2  manifest scan (blank lines dropped), month and output key from the path
S3  recursive ``*.jsonl`` scan with a declared schema; malformed lines go to a reject table
S4  sharded gz JSON manifest (``c4-train.{i:05}-of-00512.json.gz``)
S5  article JSONL sink, one directory per (month, archive)
J4  skip archives whose output already exists (left anti join)
S9  training shards: ``shard = ordinal div N`` written as one parquet directory per shard
S10 training-set scan with defaults for missing fields
S11 per-shard iteration at the consumer (streams one shard, partition by partition)
S12 tokenizer corpus: ``input + "[start] " + output + " [end]"``, records separated by a blank line
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("summary", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("publish_date", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("warc_date", T.StringType()),
])
CORRUPT = "_corrupt_record"

TRAINING_PAIR_SCHEMA = T.StructType([
    T.StructField("input_text", T.StringType()), T.StructField("output_text", T.StringType()),
    T.StructField("output_text_score", T.FloatType()), T.StructField("file_path", T.StringType()),
])
# fixed: defaults of the training-record reader for missing features
TRAINING_PAIR_DEFAULTS = {"input_text": "", "output_text": "", "output_text_score": 0.0, "file_path": ""}

C4_SHARDS = 512  # fixed: number of gz JSON shards of the C4 variant
C4_NAME = "c4-train.%05d-of-00512.json.gz"  # fixed name pattern


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_SCHEMA, glob: str = "*.jsonl") -> DataFrame:
    """S3: every ``*.jsonl`` (or other ``glob``) below ``path``; adds its order key and ``_corrupt_record``.

    Order key: ``source_file``, ``source_offset`` (start of the file's block that
    the line was read in) and ``source_row`` (rises with the lines of a block;
    a block is read by one task).
    """
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full)
          .option("recursiveFileLookup", True).option("pathGlobFilter", glob)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .json(path))
    return df.withColumn("source_file", F.col("_metadata.file_path")) \
             .withColumn("source_offset", F.col("_metadata.file_block_start")) \
             .withColumn("source_row", F.monotonically_increasing_id())


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Malformed lines (D19) go to their own table instead of failing or leaking into the store.

    Spark refuses scans that reference nothing but the corrupt-record column,
    so the parsed scan is persisted once (memory, spilling to disk) and both
    tables read from it; lost blocks are recomputed from the source files.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    bad = df.where(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "line")
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, bad


def write_articles(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines partitioned by crawl month and archive key."""
    df.write.mode(mode).partitionBy("month", "archive").json(path)


def manifest_keys(lines: DataFrame, col: str = "value") -> DataFrame:
    """S2 on manifest lines: ``path, month, out_key`` (blank lines dropped).

    ``crawl-data/<month>/segments/<seg>/warc/<file>`` -> month = second part,
    out_key = ``<month>/<parts 3.. joined by _>.jsonl``.
    """
    paths = lines.select(F.trim(col).alias("path")).where(F.length("path") > 0)
    parts = F.split("path", "/")
    return paths.select(
        "path",
        F.get(parts, 1).alias("month"),
        F.concat(F.get(parts, 1), F.lit("/"),
                 F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "_"),
                 F.lit(".jsonl")).alias("out_key"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file of archive paths -> ``path, month, out_key``."""
    return manifest_keys(spark.read.text(path))


def pending_archives(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows whose ``out_key`` is not in ``done`` (left anti join)."""
    return manifest.join(done.select("out_key").distinct(), "out_key", "left_anti")


def c4_manifest(spark: SparkSession, prefix: str = "", shards: int = C4_SHARDS) -> DataFrame:
    """The shard names, generated by Spark (one row per shard)."""
    return spark.range(shards).select(F.col("id").alias("shard"),
                                      F.concat(F.lit(prefix), F.format_string(C4_NAME, F.col("id"))).alias("name"))


def read_gz_json(spark: SparkSession, paths, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """S4 scan: gz files are not splittable (one task each), so spread rows out afterwards."""
    df = spark.read.schema(schema).json(paths)
    return df.repartition(partitions) if partitions else df


def write_shards(numbered: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per shard (shard size is bounded by ``examples_per``)."""
    (numbered.repartition("shard").sortWithinPartitions("ordinal")
     .select("shard", "ordinal", *[f.name for f in TRAINING_PAIR_SCHEMA.fields])
     .write.mode(mode).partitionBy("shard").parquet(path))


def read_training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Declared schema (no inference) and the reader's defaults for missing values."""
    df = spark.read.parquet(path)
    for f in TRAINING_PAIR_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            df = df.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return df.na.fill(TRAINING_PAIR_DEFAULTS)


def iter_shard(spark: SparkSession, path: str, shard: int):
    """Rows of one shard in order, streamed partition by partition to the consumer."""
    df = read_training_pairs(spark, path).where(F.col("shard") == shard).orderBy("ordinal")
    yield from df.toLocalIterator()


def corpus_lines(pairs: DataFrame, separator: str = "") -> DataFrame:
    """``input + [sep] + "[start] " + output + " [end]"`` (the reference puts no separator, D17)."""
    return pairs.select(F.concat(F.col("input_text"), F.lit(separator), F.lit("[start] "),
                                 F.col("output_text"), F.lit(" [end]")).alias("value"))


def write_corpus(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record per line group, records followed by a blank line."""
    lines.write.mode(mode).option("lineSep", "\n\n").text(path)
