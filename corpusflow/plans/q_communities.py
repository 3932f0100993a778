"""Queries over the encoder output: edges, candidates, star cover, pairs, shards, centroids.

The test vectors are 64 wide and their largest off-diagonal cosine is about
0.51, so the reference threshold 0.75 finds nothing here; these queries use
0.35 with the reference minimum community size 3.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import community, pairs, similarity
from corpusflow.operators.pooling import masked_mean_pool
from corpusflow.plans import standins
from corpusflow.plans.registry import register
from corpusflow.sources.tables import table

THRESHOLD = 0.35
MIN_SIZE = 3

_EDGES_SQL = f"""
emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
edges AS (
  SELECT CAST(0 AS BIGINT) AS window_id, a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS score
  FROM emb a JOIN emb b ON list_dot_product(a.v, b.v) >= {THRESHOLD})"""

_GREEDY_SQL = _EDGES_SQL + f""",
cand AS (
  SELECT window_id, src AS c, count(*) AS size, list(dst ORDER BY dst) AS members
  FROM edges GROUP BY window_id, src HAVING count(*) >= {MIN_SIZE}),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY size DESC, c ASC) AS rn FROM cand),
greedy(rn, taken, acc) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT o.rn,
         CASE WHEN list_has_any(g.taken, o.members) THEN g.taken ELSE list_concat(g.taken, o.members) END,
         CASE WHEN list_has_any(g.taken, o.members) THEN NULL ELSE o.c END
  FROM greedy g JOIN ordered o ON o.rn = g.rn + 1),
accepted AS (
  SELECT o.window_id, o.c AS center, o.size,
         row_number() OVER (PARTITION BY o.window_id ORDER BY o.size DESC, o.c) - 1 AS cluster_no
  FROM greedy g JOIN ordered o ON o.c = g.acc),
members AS (
  SELECT a.window_id, a.cluster_no, a.center, e.dst AS id, e.score,
         row_number() OVER (PARTITION BY a.window_id, a.cluster_no
                            ORDER BY (e.dst = a.center) DESC, e.score DESC, e.dst) - 1 AS member_no
  FROM accepted a JOIN edges e ON e.window_id = a.window_id AND e.src = a.center)"""


def _rows(spark, sf_dir):
    return standins.embedded_articles(spark, sf_dir)


def _edges(spark, sf_dir):
    return similarity.similarity_edges(standins.embedded_vectors(spark, sf_dir), THRESHOLD, id_col="id", vec_col="vector",
                                       window_col="window_id")


@register("cosine_edges", f"WITH RECURSIVE {_EDGES_SQL} SELECT window_id, src, dst, score FROM edges")
def cosine_edges(spark, sf_dir):
    """Blocked exact cosine self-join, both directions plus self."""
    return _edges(spark, sf_dir)


@register("degree_candidates", f"""WITH {_EDGES_SQL}
SELECT window_id, src AS id, count(*) AS size FROM edges GROUP BY window_id, src HAVING count(*) >= {MIN_SIZE}""")
def degree_candidates(spark, sf_dir):
    """Rows whose neighbourhood (self included) has at least MIN_SIZE members."""
    return community.candidates(_edges(spark, sf_dir), MIN_SIZE)


def _members(spark, sf_dir):
    return community.communities_of_vectors(standins.embedded_vectors(spark, sf_dir), THRESHOLD, MIN_SIZE)


@register("star_communities", f"WITH RECURSIVE {_GREEDY_SQL} SELECT window_id, cluster_no, center, size FROM accepted")
def star_communities(spark, sf_dir):
    """Exact distributed greedy star cover, numbered in acceptance order."""
    members = _members(spark, sf_dir)
    return (members.groupBy("window_id", "cluster_no", "center")
            .agg(F.count(F.lit(1)).alias("size")))


@register("cluster_members", f"""WITH RECURSIVE {_GREEDY_SQL}
SELECT window_id, cluster_no, member_no, center, id, score FROM members""")
def cluster_members(spark, sf_dir):
    """C4: members with centre first, then score desc, id asc."""
    return _members(spark, sf_dir)


_PAIRS_SQL = _GREEDY_SQL + f""",
{standins.ARTICLES_SQL.strip()},
pairs AS (
  SELECT c.title AS input_text, m.title AS output_text, CAST(x.score AS FLOAT) AS output_text_score,
         'clusters/{standins.EMBEDDED_WINDOW_FILE}/A' || CAST(x.cluster_no AS VARCHAR) || 'S0S'
           || CAST(x.member_no AS VARCHAR) AS file_path,
         x.cluster_no, x.member_no
  FROM members x
  JOIN articles m ON m.id = x.id
  JOIN articles c ON c.id = x.center
  WHERE x.member_no >= 1 AND x.score > 0 AND x.score < 0.95
    AND m.title IS NOT NULL AND c.title IS NOT NULL)"""


def _pairs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return pairs.sister_pairs(_members(spark, sf_dir), rows, standins.embedded_window_names(rows))


@register("sister_pairs", f"""WITH RECURSIVE {_PAIRS_SQL}
SELECT input_text, output_text, output_text_score, file_path FROM pairs""")
def sister_pairs(spark, sf_dir):
    """Flagship: vectors -> edges -> star cover -> (centre title, member title, score, lineage)."""
    return _pairs(spark, sf_dir).select("input_text", "output_text", "output_text_score", "file_path")


@register("shard_assignment", f"""WITH RECURSIVE {_PAIRS_SQL}
SELECT file_path, CAST(row_number() OVER (ORDER BY cluster_no, member_no) - 1 AS BIGINT) AS ordinal,
       CAST(floor((row_number() OVER (ORDER BY cluster_no, member_no) - 1) / {pairs.EXAMPLES_PER_SHARD}) AS BIGINT) AS shard
FROM pairs""")
def shard_assignment(spark, sf_dir):
    """Distributed ordinal over pairs, shard = ordinal div 10,000 (short last shard kept)."""
    return pairs.assign_shards(_pairs(spark, sf_dir)).select("file_path", "ordinal", "shard")


@register("centroid_normalized", """WITH x AS (
  SELECT label, i AS dim, CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, range(1, len(embedding) + 1) t(i)),
m AS (SELECT label, dim, avg(v) AS mean FROM x GROUP BY label, dim),
n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY label)
SELECT m.label, CAST(m.dim - 1 AS BIGINT) AS dim, m.mean / greatest(n.norm, 1e-12) AS value
FROM m JOIN n USING (label)""")
def centroid_normalized(spark, sf_dir):
    """Mean vector per label (all-ones mask), L2-normalised, long form."""
    emb = table(spark, sf_dir, "embeddings")
    pooled = masked_mean_pool(emb, ["label"], "embedding")
    return pooled.select("label", F.posexplode("vector").alias("dim", "value")) \
                 .select("label", F.col("dim").cast("long"), "value")


@register("cluster_json_pairs", f"""WITH RECURSIVE {_PAIRS_SQL}
SELECT input_text, output_text, output_text_score, file_path FROM pairs""")
def cluster_json_pairs(spark, sf_dir):
    """A11 + S7 + S8: communities written as cluster JSON lines, parsed back, paired (same result as sister_pairs)."""
    from corpusflow.sources import clusters

    rows = _rows(spark, sf_dir)
    lines = clusters.cluster_lines(_members(spark, sf_dir), rows.select("window_id", "id", "title", "text",
                                                                       "publish_date"),
                                   standins.embedded_window_names(rows))
    return clusters.pairs_from_lines(lines)


@register("cluster_preview", f"""WITH RECURSIVE {_GREEDY_SQL},
{standins.ARTICLES_SQL.strip()}
SELECT m.cluster_no, m.member_no, m.id, a.title FROM members m LEFT JOIN articles a ON a.id = m.id
WHERE m.member_no < 2""")
def cluster_preview(spark, sf_dir):
    """First two members of every cluster with their titles."""
    from corpusflow.sources import clusters

    rows = _rows(spark, sf_dir)
    prev = clusters.cluster_preview(_members(spark, sf_dir), rows.select("window_id", "id", "title"))
    return prev.select("cluster_no", "member_no", "id", "title")


@register("cluster_json", f"""WITH RECURSIVE {_GREEDY_SQL},
{standins.ARTICLES_SQL.strip()}
SELECT '{standins.EMBEDDED_WINDOW_FILE}' AS file_name, 'A' || CAST(m.cluster_no AS VARCHAR) AS cluster,
       'S' || CAST(m.member_no AS VARCHAR) AS member, a.title, m.score, CAST(length(a.text) AS BIGINT) AS text_chars,
       CASE WHEN m.member_no > 0 THEN 1
            ELSE greatest(count(*) OVER (PARTITION BY m.window_id, m.cluster_no) - 1, 1) END AS lines
FROM members m LEFT JOIN articles a ON a.id = m.id""")
def cluster_json(spark, sf_dir):
    """Cluster JSON lines written to files, scanned back and parsed: every member and in how many lines it stands."""
    import uuid

    from corpusflow.session import ensure_checkpoint_dir
    from corpusflow.sources import clusters

    rows = _rows(spark, sf_dir)
    lines = clusters.cluster_lines(_members(spark, sf_dir), rows.select("window_id", "id", "title", "text",
                                                                       "publish_date"),
                                   standins.embedded_window_names(rows))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clusters-{uuid.uuid4().hex}"
    clusters.write_cluster_lines(lines, path)
    parsed = clusters.read_cluster_lines(spark, path).select("file_name", F.from_json("value", clusters.LINE_TYPE).alias("m"))
    members = (parsed.select("file_name", F.explode("m").alias("cluster", "ms"))
               .select("file_name", "cluster", F.explode("ms").alias("member", "a")))
    return members.groupBy("file_name", "cluster", "member").agg(
        F.first("a.title").alias("title"), F.first("a.score").alias("score"),
        F.first(F.length("a.text").cast("long")).alias("text_chars"), F.count(F.lit(1)).alias("lines"))
