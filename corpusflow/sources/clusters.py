"""Cluster JSON lines - build, write, scan, and turn back into pairs.

Line format (one object per line, per window file)::

    {"A<i>": {"S0": {...centre...}, "S<j>": {title, url, publish_date 'yyyy-MM-dd',
              summary?, domain?, authors?, split?, status?, text, score}, ...}}

Missing optional fields are left out (``to_json`` drops nulls).  A line holds
one pair: the centre ``S0`` and one later member (a cluster of one has a line
with its centre alone).  The consumer pairs the first member of a line with
every other one, so this gives the same pairs and lineage paths as a line per
cluster would, clusters of every size are written alike, and no task collects a
group.  ``max_members`` packs more members to a line where a file's reader
wants fewer lines; ``chunk`` numbers a cluster's lines in either case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.pairs import SCORE_HIGH, SCORE_LOW

MEMBERS_PER_LINE = 1

MEMBER_STRUCT = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("publish_date", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("domain", T.StringType()), T.StructField("authors", T.ArrayType(T.StringType())),
    T.StructField("split", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType()),
])
LINE_TYPE = T.MapType(T.StringType(), T.MapType(T.StringType(), MEMBER_STRUCT))


def _member_struct(df: DataFrame):
    cols = []
    for f in MEMBER_STRUCT.fields:
        if f.name == "publish_date" and "publish_date" in df.columns:
            cols.append(F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return F.struct(*cols)


def cluster_lines(members: DataFrame, articles: DataFrame, window_names: DataFrame,
                  max_members: int = MEMBERS_PER_LINE) -> DataFrame:
    """``file_name, cluster_no, chunk, value`` (the JSON line).

    ``members``: window_id, cluster_no, member_no, id, score (C4);
    ``articles``: window_id, id and any of title, url, publish_date (date),
    summary, domain, authors, split, status, text.
    """
    sizes = members.groupBy("window_id", "cluster_no").agg(F.count(F.lit(1)).alias("_size"))
    m = members.join(articles, ["window_id", "id"], "left").join(sizes, ["window_id", "cluster_no"])
    nchunks = F.greatest(F.lit(1), F.ceil((F.col("_size") - 1) / F.lit(max_members)))
    # S0 goes to every chunk of its cluster; others to chunk (member_no - 1) div max_members
    chunks = F.when(F.col("member_no") == 0, F.sequence(F.lit(0), nchunks.cast("int") - 1)) \
              .otherwise(F.array(F.floor((F.col("member_no") - 1) / F.lit(max_members)).cast("int")))
    m = m.withColumn("chunk", F.explode(F.transform(chunks, lambda c: c.cast("long"))))
    entries = m.groupBy("window_id", "cluster_no", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col("member_no").alias("n"), _member_struct(m).alias("a"))))
        .alias("_ms"))
    inner = F.map_from_entries(F.transform("_ms", lambda x: F.struct(
        F.concat(F.lit("S"), x["n"].cast("string")), x["a"])))
    line = F.to_json(F.create_map(F.concat(F.lit("A"), F.col("cluster_no").cast("string")), inner))
    return entries.join(window_names, "window_id").select("file_name", "cluster_no", "chunk",
                                                          line.alias("value"))


def write_cluster_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per window file; lines ordered by cluster and chunk within each task."""
    (lines.repartitionByRange("file_name", "cluster_no", "chunk")
     .sortWithinPartitions("file_name", "cluster_no", "chunk")
     .select("file_name", "value")
     .write.mode(mode).partitionBy("file_name").text(path))


def read_cluster_lines(spark, path: str) -> DataFrame:
    """``file_name, value`` from a directory written by :func:`write_cluster_lines`."""
    return spark.read.text(path).select("file_name", "value")


def pairs_from_lines(lines: DataFrame, folder: str = "clusters", low: float = SCORE_LOW,
                     high: float = SCORE_HIGH) -> DataFrame:
    """P12 / P15 / J7 / F10 on cluster lines: the first member of a line against every later one.

    Members are ordered by the number after ``S`` (not by text order), rows
    lacking a title or score are skipped one by one.
    """
    parsed = lines.select("file_name", F.from_json("value", LINE_TYPE).alias("m"))
    first = parsed.select("file_name", F.map_entries("m")[0].alias("c"))
    members = first.select("file_name", F.col("c.key").alias("akey"),
                           F.array_sort(F.transform(F.map_entries(F.col("c.value")), lambda e: F.struct(
                               F.substring(e["key"], 2, 1 << 20).cast("long").alias("n"),
                               e["key"].alias("k"), e["value"].alias("a")))).alias("ms"))
    s0 = F.col("ms")[0]
    rest = members.select("file_name", "akey", s0["k"].alias("k0"), s0["a"]["title"].alias("input_text"),
                          F.explode(F.slice("ms", 2, 1 << 30)).alias("x"))
    ok = rest.where(F.col("input_text").isNotNull() & F.col("x.a.title").isNotNull()
                    & F.col("x.a.score").isNotNull() & (F.col("x.a.score") > low) & (F.col("x.a.score") < high))
    return ok.select(
        "input_text", F.col("x.a.title").alias("output_text"),
        F.col("x.a.score").cast("float").alias("output_text_score"),
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file_name"), F.lit("/"), F.col("akey"),
                 F.col("k0"), F.col("x.k")).alias("file_path"))


def cluster_preview(members: DataFrame, articles: DataFrame, per_cluster: int = 2) -> DataFrame:
    """The first ``per_cluster`` members of each cluster with title, summary and article url."""
    head = members.where(F.col("member_no") < per_cluster)
    cols = [c for c in ("title", "summary", "url") if c in articles.columns]
    return head.join(articles.select("window_id", "id", *cols), ["window_id", "id"], "left")

