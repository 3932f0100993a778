"""Incremental JSONL ingest into the article store, unique on text.

``readStream`` over a folder of ``*.jsonl`` drops (declared schema, malformed
lines kept aside), ``cleanSource=archive`` moves finished files to a backup
folder (S16), the stream checkpoint remembers finished files (T3: a restart
skips them).  Each micro-batch goes through ``foreachBatch``:

1. W1 inside the batch: first row per text by (file, offset);
2. J5 against the digests of the stored texts (a column of the store; its texts are not read);
3. publish dates parsed (F7), original string kept;
4. written to ``store/batch_id=<id>`` with overwrite of that one partition,
   so a micro-batch replayed after a failure replaces its own output instead
   of appending twice (exactly-once effect on the table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.store import insert_absent, key_digest, parse_publish_date
from corpusflow.sources.files import ARTICLE_SCHEMA, CORRUPT


def _stream(spark: SparkSession, source_dir: str, schema: T.StructType, archive_dir: str | None,
            max_files: int | None, glob: str = "*.jsonl") -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    r = (spark.readStream.schema(full).option("pathGlobFilter", glob)
         .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.json(source_dir)
    return df.withColumn("source_file", F.col("_metadata.file_path")) \
             .withColumn("source_offset", F.col("_metadata.file_block_start"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop filesystem API (works for any cluster filesystem)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.globStatus(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/batch_id=*"))) > 0


def path_exists_any(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def store_batch(store_path: str, text_col: str = "text", date_col: str | None = "publish_date"):
    """The ``foreachBatch`` function: W1 + J5 + F7 + idempotent partition write."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        rows = batch.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        rejects = batch.where(F.col(CORRUPT).isNotNull())
        if date_col:
            rows = rows.withColumn(f"{date_col}_raw", F.col(date_col)) \
                       .withColumn(date_col, parse_publish_date(F.col(date_col)))
        rows = rows.withColumn("_line", F.monotonically_increasing_id())
        if path_exists(spark, store_path):
            stored = spark.read.parquet(store_path).where(F.col("batch_id") != batch_id).select(f"{text_col}_digest")
        else:
            stored = spark.createDataFrame([], T.StructType([T.StructField(text_col, T.StringType())]))
        fresh = insert_absent(stored, rows, text_col, ["source_file", "source_offset", "_line"]).drop("_line")
        (fresh.withColumn(f"{text_col}_digest", key_digest(text_col)).withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(store_path))
        if not rejects.isEmpty():
            (rejects.select("source_file", F.col(CORRUPT).alias("line"), F.lit(batch_id).cast("long").alias("batch_id"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(store_path.rstrip("/") + "_rejects"))
        batch.unpersist()

    return run


def run_ingest(spark: SparkSession, source_dir: str, store_path: str, checkpoint: str,
               archive_dir: str | None = None, schema: T.StructType = ARTICLE_SCHEMA,
               max_files_per_trigger: int | None = None, text_col: str = "text",
               date_col: str | None = "publish_date", glob: str = "*.jsonl") -> None:
    """Process every file available now (``availableNow`` trigger), then return."""
    q = (_stream(spark, source_dir, schema, archive_dir, max_files_per_trigger, glob)
         .writeStream.foreachBatch(store_batch(store_path, text_col, date_col))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    return spark.read.parquet(store_path)
