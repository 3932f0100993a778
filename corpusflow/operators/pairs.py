"""Communities to scored training pairs and shards.

The consumer of a cluster line pairs the first member (the centre, ``S0``)
with every later member whose score lies strictly between the bounds, and
skips members without a title or score one by one.  Here that is a join of
member rows with their centre's attributes - no per-cluster collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordinals import with_ordinal

# fixed values of the pair consumer: score band, both ends strict
SCORE_LOW, SCORE_HIGH = 0.0, 0.95
# fixed value of the shard writer: examples per shard
EXAMPLES_PER_SHARD = 10_000


def window_file_name(start: str | Column, end: str | Column,
                     suffix: str = "-sister-articles.jsonl") -> Column:
    """``Y-M-D-to-Y-M-D-sister-articles.jsonl`` with unpadded month and day."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end

    def ymd(d: Column) -> Column:
        return F.concat_ws("-", F.year(d), F.month(d), F.dayofmonth(d))

    return F.concat(ymd(s), F.lit("-to-"), ymd(e), F.lit(suffix))


def lineage_path(file_col: str | Column, cluster_no: str | Column, member_no: str | Column,
                 folder: str = "clusters") -> Column:
    """``<folder>/<file>/A<i>S0S<n>`` (no separators after the slash)."""
    f = F.col(file_col) if isinstance(file_col, str) else file_col
    c = F.col(cluster_no) if isinstance(cluster_no, str) else cluster_no
    m = F.col(member_no) if isinstance(member_no, str) else member_no
    return F.concat(F.lit(folder.rstrip("/") + "/"), f, F.lit("/A"), c.cast("string"),
                    F.lit("S0S"), m.cast("string"))


def sister_pairs(members: DataFrame, articles: DataFrame, window_names: DataFrame,
                 folder: str = "clusters", low: float = SCORE_LOW, high: float = SCORE_HIGH) -> DataFrame:
    """Training pairs ``input_text, output_text, output_text_score, file_path`` (+ ordering keys).

    ``members``: window_id, cluster_no, member_no, center, id, score (C4).
    ``articles``: window_id, id, title (attributes of the clustered rows).
    ``window_names``: window_id, file_name (one row per window, F11).
    """
    attrs = articles.select("window_id", "id", "title")
    centre_titles = attrs.select("window_id", F.col("id").alias("center"), F.col("title").alias("input_text"))
    later = (members.where((F.col("member_no") >= 1) & F.col("score").isNotNull()
                           & (F.col("score") > low) & (F.col("score") < high))
             .join(attrs, ["window_id", "id"])
             .where(F.col("title").isNotNull()))
    pairs = (later.join(centre_titles, ["window_id", "center"])
             .where(F.col("input_text").isNotNull())
             .join(window_names, "window_id"))
    return pairs.select(
        "window_id", "cluster_no", "member_no", F.col("file_name"),
        F.col("input_text"), F.col("title").alias("output_text"),
        F.col("score").cast("float").alias("output_text_score"),
        lineage_path("file_name", "cluster_no", "member_no", folder).alias("file_path"))


def assign_shards(pairs: DataFrame, examples_per: int = EXAMPLES_PER_SHARD,
                  drop_remainder: bool = False) -> DataFrame:
    """Number pairs in (file, cluster, member) order and cut shards of ``examples_per``.

    The reference flushes only full shards (D6); ``drop_remainder=True``
    reproduces that, the default keeps the last short shard.
    """
    numbered = with_ordinal(pairs, [F.col("file_name"), F.col("cluster_no"), F.col("member_no")],
                            name="ordinal")
    out = numbered.withColumn("shard", F.floor(F.col("ordinal") / F.lit(examples_per)).cast("long"))
    if drop_remainder:
        # one row per shard; keep shards that are full (only the last can be short)
        full = (out.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") == examples_per).select("shard"))
        out = out.join(full, "shard", "left_semi")
    return out
