"""The windowed chain end to end, finds by date, and the file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators import calendar as C
from corpusflow.operators import community, metrics, pairs
from corpusflow.operators import store as S
from corpusflow.operators.pooling import masked_mean_pool
from corpusflow.plans import q_communities, standins
from corpusflow.plans.q_store import _DATES_SQL, A
from corpusflow.plans.registry import register
from corpusflow.session import cut_lineage, ensure_checkpoint_dir
from corpusflow.sources import files
from corpusflow.sources.tables import table

# the test vectors are nearly orthogonal and a window has some twenty of them
THRESHOLD = 0.15
MIN_SIZE = 2

_CHAIN_SQL = f"""{_DATES_SQL},
keyed AS (SELECT *, title || ' -- ' || sha256(text) AS k FROM wa WHERE title IS NOT NULL AND text IS NOT NULL),
firsts AS (SELECT window_id, arg_min(id, (publish_date, id)) AS id FROM keyed GROUP BY window_id, k),
emb AS (SELECT f.window_id, f.id, a.title, CAST(e.embedding AS DOUBLE[]) AS v
        FROM firsts f JOIN embeddings e ON e.vec_id = f.id JOIN articles a ON a.id = f.id),
edges AS (
  SELECT a.window_id, a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS score
  FROM emb a JOIN emb b ON a.window_id = b.window_id AND list_dot_product(a.v, b.v) >= {THRESHOLD}),
cand AS (""" + q_communities._GREEDY_SQL.partition("cand AS (")[2].replace(
    f"HAVING count(*) >= {q_communities.MIN_SIZE}", f"HAVING count(*) >= {MIN_SIZE}")


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@register("windowed_sister_pairs", f"""WITH RECURSIVE {_CHAIN_SQL}
SELECT x.window_id, c.title AS input_text, m.title AS output_text, CAST(x.score AS FLOAT) AS output_text_score,
  'clusters/' || concat_ws('-', year(w.start), month(w.start), day(w.start)) || '-to-'
    || concat_ws('-', year(w."end"), month(w."end"), day(w."end")) || '-sister-articles.jsonl/A'
    || CAST(x.cluster_no AS VARCHAR) || 'S0S' || CAST(x.member_no AS VARCHAR) AS file_path
FROM members x JOIN emb m ON m.id = x.id JOIN emb c ON c.id = x.center JOIN win w ON w.window_id = x.window_id
WHERE x.member_no >= 1 AND x.score > 0 AND x.score < 0.95""")
def windowed_sister_pairs(spark, sf_dir):
    """A2 -> W3 -> J2 -> W2 -> vectors by id -> J3 per window -> C3 -> pairs with their window's file name."""
    articles = standins.articles(spark, sf_dir).select("id", "title", "text", "publish_date")
    windows = cut_lineage(C.date_windows(C.qualifying_dates(articles)))
    kept = C.window_dedup(C.window_articles(articles, windows), keep=["id", "title"]).select("window_id", "id", "title")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = cut_lineage(kept.join(vectors, "id"))
    members = community.communities_of_vectors(rows, THRESHOLD, MIN_SIZE)
    names = windows.select("window_id", pairs.window_file_name("start", "end").alias("file_name"))
    return pairs.sister_pairs(members, rows, names).select(
        "window_id", "input_text", "output_text", "output_text_score", "file_path")


@register("articles_in_range", f"""WITH {A}
SELECT id, title, publish_date FROM articles WHERE publish_date BETWEEN DATE '2024-02-01' AND DATE '2024-03-15'""")
def articles_in_range(spark, sf_dir):
    """Articles between two dates, newest first."""
    return C.latest_first(C.in_range(standins.articles(spark, sf_dir), "2024-02-01", "2024-03-15")) \
        .select("id", "title", "publish_date")


@register("articles_in_month", f"""WITH {A}
SELECT id, title, publish_date FROM articles WHERE year(publish_date) = 2024 AND month(publish_date) = 5""")
def articles_in_month(spark, sf_dir):
    """Articles of one month, newest first."""
    return C.latest_first(C.in_month(standins.articles(spark, sf_dir), 2024, 5)).select("id", "title", "publish_date")


@register("masked_pooling", """WITH x AS (
  SELECT CAST(floor(vec_id / 32) AS BIGINT) AS batch, i AS dim, CAST(embedding[i] AS DOUBLE) AS v,
         CASE WHEN label <> 0 THEN 1 ELSE 0 END AS mk
  FROM embeddings, range(1, len(embedding) + 1) t(i)),
m AS (SELECT batch, dim, sum(v * mk) / greatest(sum(mk), 1e-9) AS mean FROM x GROUP BY batch, dim),
n AS (SELECT batch, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY batch)
SELECT m.batch, CAST(m.dim - 1 AS BIGINT) AS dim, m.mean / greatest(n.norm, 1e-12) AS value FROM m JOIN n USING (batch)""")
def masked_pooling(spark, sf_dir):
    """A6 with a mask: 32 consecutive vectors are a sentence's tokens, those of label 0 are padding."""
    tokens = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 32).cast("long").alias("batch"), "embedding",
        F.when(F.col("label") != 0, 1.0).otherwise(0.0).alias("mask"))
    pooled = masked_mean_pool(tokens, ["batch"], "embedding", "mask")
    return pooled.select("batch", F.posexplode("vector").alias("dim", "value")) \
                 .select("batch", F.col("dim").cast("long"), "value")


@register("shard_round_trip", f"""WITH RECURSIVE {q_communities._PAIRS_SQL}
SELECT input_text, output_text, output_text_score, file_path,
       CAST(floor((row_number() OVER (ORDER BY cluster_no, member_no) - 1) / 100) AS BIGINT) AS shard
FROM pairs""")
def shard_round_trip(spark, sf_dir):
    """S9 -> S10: numbered pairs written as shards of 100 examples, scanned back with the reader's defaults."""
    path = _scratch(spark)
    files.write_shards(pairs.assign_shards(q_communities._pairs(spark, sf_dir), examples_per=100), path)
    return files.read_training_pairs(spark, path).select(
        "input_text", "output_text", "output_text_score", "file_path", F.col("shard").cast("long"))


_DROP_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                             T.StructField("publish_date", T.StringType())])


@register("store_load", """SELECT min(doc_id) AS doc_id, count(*) AS copies,
  CAST(DATE '2024-01-01' + CAST(((min(doc_id) * min(doc_id)) % 211) AS INTEGER) AS DATE) AS publish_date
FROM documents GROUP BY text""")
def store_load(spark, sf_dir):
    """S3 -> W1 -> F7: JSON line files (documents in id order) scanned, first row per text kept, dates parsed."""
    path = _scratch(spark)
    docs = standins.articles(spark, sf_dir).select(
        F.col("id").alias("doc_id"), "text", S.format_publish_date("publish_date").alias("publish_date"))
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.json(f"{path}/drop.jsonl.d")
    rows = files.read_jsonl(spark, path, _DROP_SCHEMA, glob="*.json")
    kept = S.unique_first(rows.select(*_DROP_SCHEMA.names, "source_file", "source_offset", "source_row"), "text",
                          ["source_file", "source_offset", "source_row"], count_col="copies")
    return kept.select("doc_id", "copies", S.parse_publish_date("publish_date").alias("publish_date"))


_UNIT_SQL = """t AS (
  SELECT CAST(floor(vec_id / 48) AS BIGINT) AS batch_id, CAST(floor((vec_id % 48) / 3) AS BIGINT) AS r, vec_id % 3 AS part,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT batch_id, r, part,
             list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM t)"""


def _parts(spark, sf_dir):
    """Stand-in: three consecutive vectors are anchor, positive and negative of a row, 16 rows a batch."""
    e = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 48).cast("long").alias("batch_id"),
        F.floor(F.col("vec_id") % 48 / 3).cast("long").alias("row"), (F.col("vec_id") % 3).alias("part"), "embedding")
    return [e.where(F.col("part") == k).select("batch_id", "row", F.col("embedding").alias(name))
            for k, name in enumerate(("anchor", "positive", "negative"))]


@register("contrastive_pairs", f"""WITH {_UNIT_SQL},
s AS (SELECT a.batch_id, a.r AS i, p.r AS j, 20 * list_dot_product(a.v, p.v) AS s
      FROM u a JOIN u p ON a.batch_id = p.batch_id AND a.part = 0 AND p.part = 1
      WHERE EXISTS (SELECT 1 FROM u x WHERE x.batch_id = a.batch_id AND x.r = a.r AND x.part = 1)),
f AS (SELECT batch_id, i, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY batch_id, i),
g AS (SELECT batch_id, j, ln(sum(exp(s))) - max(CASE WHEN i = j THEN s END) AS l FROM s GROUP BY batch_id, j)
SELECT batch_id, (SELECT count(*) FROM f WHERE f.batch_id = b.batch_id) AS rows,
  ((SELECT avg(l) FROM f WHERE f.batch_id = b.batch_id) + (SELECT avg(l) FROM g WHERE g.batch_id = b.batch_id)) / 2 AS loss
FROM (SELECT DISTINCT batch_id FROM s) b""")
def contrastive_pairs(spark, sf_dir):
    """A9 / J9 on pairs: symmetric in-batch loss (scale 20) of anchors and positives."""
    a, p, _ = _parts(spark, sf_dir)
    return metrics.in_batch_contrastive(a.join(p, ["batch_id", "row"]))


@register("contrastive_triples", f"""WITH {_UNIT_SQL},
full3 AS (SELECT batch_id, r FROM u GROUP BY batch_id, r HAVING count(*) = 3),
c AS (SELECT u.* FROM u JOIN full3 USING (batch_id, r)),
s AS (SELECT a.batch_id, a.r AS i, p.r AS j, p.part, 20 * list_dot_product(a.v, p.v) AS s
      FROM c a JOIN c p ON a.batch_id = p.batch_id AND a.part = 0 AND p.part > 0),
f AS (SELECT batch_id, i, ln(sum(exp(s))) - max(CASE WHEN i = j AND part = 1 THEN s END) AS l FROM s GROUP BY batch_id, i)
SELECT batch_id, count(*) AS rows, avg(l) AS loss FROM f GROUP BY batch_id""")
def contrastive_triples(spark, sf_dir):
    """A9 / J9 on triples: anchors against the batch's positives and negatives (scale 20)."""
    a, p, n = _parts(spark, sf_dir)
    return metrics.in_batch_contrastive(a.join(p, ["batch_id", "row"]).join(n, ["batch_id", "row"]), negative="negative")
