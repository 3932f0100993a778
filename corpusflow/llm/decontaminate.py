"""Benchmark decontamination by containment search, native Spark expressions only.

Short items are looked for inside long documents.  The similarity is
containment: the share of an item's distinct shingles that the document holds.
A MinHash of the whole document would say nothing about a passage of a few
dozen words, so the sketch is taken from the item alone: the bottom-k MinHash
shingles of the item are tested for membership in the document's shingle set.

Items are partitioned by size (distinct shingles, in powers of two), and each
partition has its own k.  An item with n shingles may miss at most
n - ceil(t * n) of them at threshold t, so with k one larger than that number
for the partition's largest size, every item at or above the threshold has a
sketch shingle in the document: the search loses no pair.  Candidates are then
verified by exact containment of the shingle texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick, positional, small

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch rows (hash, item, width: some 40 bytes) that are still broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes of the items' shingle texts that are still broadcast to verify candidates; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def plain_words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.array_remove(
        F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "), " ", -1), "")


def shingle_hashes(width: int) -> Column:
    """64-bit hashes of the ``width``-word windows of column ``w`` (none if there are fewer words)."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("w") - width),
        lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(width)]))
    return F.when(F.size("w") >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, width: Column) -> Column:
    """Distinct ``width``-word windows as texts."""
    texts = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1),
                        lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when((F.size(words) >= width) & (width > 0),
                  F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def sketch_size(upper: int, threshold: float) -> int:
    """How many sketch shingles a size partition with at most ``upper`` shingles needs."""
    return upper - math.ceil(threshold * upper - 1e-9) + 1


def item_sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item, width, shingles, sketch): one row per item with a word; ``width`` is the shingle length.

    An item of fewer words than a shingle is one shingle of all its words.
    """
    words = items.select("item", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    wide = words.withColumn("width", F.least(F.lit(shingle), F.size("w")))
    wide = wide.withColumn("shingles", shingle_texts(F.col("w"), F.col("width")))
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingle_hashes(k)) for k in range(1, shingle + 1)])
    sized = wide.withColumn("hashes", F.sort_array(F.array_distinct(hashes)))
    sized = sized.withColumn("size_class", F.ceil(F.log2(F.size("hashes"))).cast("int"))
    upper = F.pow(F.lit(2.0), F.col("size_class"))
    k = (upper - F.ceil(threshold * upper - 1e-9) + 1).cast("int")
    return sized.select("item", "width", "size_class", "shingles", F.slice("hashes", F.lit(1), k).alias("sketch"))


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (doc, item) where the document holds a shingle of the item's sketch.

    Each document row is exploded into its shingles and probed against the
    sketch table: no document text is shuffled, only hits are.
    """
    rows = checkpoint(sketches.select("item", "width", F.explode("sketch").alias("h")))
    widths = sorted(r[0] for r in rows.select("width").distinct().collect())  # at most `shingle` values
    probe = small(rows, BROADCAST_ROWS)
    words = docs.select("doc", plain_words(F.col("text")).alias("w"))
    found = None
    for width in widths:
        hits = (words.select("doc", F.explode(shingle_hashes(width)).alias("h"))
                .join(probe.where(F.col("width") == width), "h").select("doc", "item"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.select("doc").limit(0).crossJoin(sketches.select("item").limit(0))
    return found.distinct()


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item it contains: id, item id, n_shingles, n_found, containment.

    ``containment`` is the share of the item's distinct word shingles found in
    the document, at least ``threshold``.  Words are runs of letters and digits
    in lower case.  Null or wordless texts match nothing.  Ids may be null and
    match as such; of repeated document or item ids the best pair is reported.
    Empty tables give an empty result.  Other columns are ignored.
    """
    d = pick(docs, doc=id_col, text=text_col)
    it = pick(items, item=item_col, text=item_text_col)
    sketches = checkpoint(item_sketches(it, shingle, threshold))
    pairs = checkpoint(candidates(d, sketches))
    probe = small(pairs, BROADCAST_ROWS)
    chars = F.aggregate("shingles", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s))
    few = (sketches.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_BYTES
    by_item = small(sketches, BROADCAST_ROWS // 50) if few else sketches
    joined = d.alias("d").join(probe.alias("p"), F.col("d.doc").eqNullSafe(F.col("p.doc")))
    full = joined.select("d.doc", "p.item", "text").alias("f").join(
        by_item.alias("s"), F.col("f.item").eqNullSafe(F.col("s.item")))
    checked = (full.select("f.doc", "f.item", "width", "shingles", plain_words(F.col("text")).alias("w"))
               .withColumn("n_found", F.size(F.array_intersect(
                   F.col("shingles"), shingle_texts(F.col("w"), F.col("width"))))))
    exact = checked.select(
        "doc", "item", F.size("shingles").cast("long").alias("n_shingles"), F.col("n_found").cast("long"))
    best = exact.groupBy("doc", "item").agg(F.max(F.struct(
        (F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_found", "n_shingles")).alias("b"))
    # the threshold stands above the aggregation: below it, Spark would push it under the projection that makes
    # the words, and evaluate them again for every shingle
    return (best.where(F.col("b.containment") >= threshold - 1e-9)
            .select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "b.n_shingles", "b.n_found",
                    "b.containment"))


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item.

    Rows are told apart by the SHA-256 of their text, as the text alone decides:
    ids may be null or repeat.  Rows with null text stay.
    """
    options.pop("id_col", None)
    rows, text_col = positional(docs), options.pop("text_col", "text")
    text = F.col(f"_in{docs.columns.index(text_col)}")
    own = F.unhex(F.sha2(text, 256))
    found = contained_items(rows.select(own.alias("doc"), text.alias("text")), items, id_col="doc", text_col="text", **options)
    hit = checkpoint(found.select(F.col("doc").alias("_hit")).distinct())
    return rows.join(small(hit, BROADCAST_ROWS), own == F.col("_hit"), "left_anti").toDF(*docs.columns)


#: DuckDB: containment of every item in every document, by brute force over all shingles.
SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark),
iw AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
ish AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM iw)),
n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM iw),
dsh AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM w, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS n_found FROM dsh JOIN ish USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment
FROM m JOIN n USING (item_id)
WHERE CAST(n_found AS DOUBLE) / n_shingles >= 0.8 - 1e-9
"""
