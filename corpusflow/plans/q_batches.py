"""Training-input and metric queries.

Stand-in token ids for the batch queries: the character length of each
whitespace-separated word of a document (never 0, so 0 stays the padding
id).  They only give ``ids`` rows of the right shape; all shaping is the
library's.  Real subword ids come from ``bpe_encode``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.functions.hashing import seeded_hash_sql
from corpusflow.operators import batching as B
from corpusflow.operators import metrics as M
from corpusflow.plans import q_text
from corpusflow.plans.registry import register
from corpusflow.plans.sqlgen import s
from corpusflow.sources.tables import table

SEED = 42
EPOCH = 0
TRAIN_PCT = 90
_SHUFFLE_SEED_SQL = f"({SEED} * 1000003 + {EPOCH})"


def word_length_ids(text_col="text"):
    words = F.filter(F.split(F.col(text_col), X.WS + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.length(w).cast("long"))


_IDS_SQL = f"""ids AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, {s(X.WS + '+')}), lambda w: w <> ''),
                                lambda w: CAST(length(w) AS BIGINT)) AS ids
  FROM documents)"""

_SHUF_SQL = f"""shuf AS (
  SELECT doc_id, row_number() OVER (ORDER BY {seeded_hash_sql('doc_id', _SHUFFLE_SEED_SQL)}, doc_id) - 1 AS ord
  FROM documents),
bat AS (SELECT doc_id, CAST(floor(ord / {B.BATCH_SIZE}) AS BIGINT) AS batch_id, CAST(ord % {B.BATCH_SIZE} AS BIGINT) AS "row" FROM shuf)"""

_PAD_SQL = f"""{_IDS_SQL}, {_SHUF_SQL},
padded AS (
  SELECT b.batch_id, b."row", b.doc_id, CAST(len(i.ids) AS BIGINT) AS seq_len,
         CAST(max(len(i.ids)) OVER (PARTITION BY b.batch_id) AS BIGINT) AS pad_len, i.ids
  FROM bat b JOIN ids i USING (doc_id)),
p2 AS (SELECT *, list_resize(ids, pad_len, 0) AS padded FROM padded)"""


def _wsum_sql(arr: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({arr}, lambda x, i: CAST(x AS BIGINT) * i)), 0) AS BIGINT)"


@register("capped_short_texts", f"""WITH {q_text._ART_SQL},
ok AS (SELECT doc_id, text FROM art
       WHERE summary IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, CAST(length(text) AS BIGINT) AS text_chars FROM ok
WHERE length(text) < {B.MAX_TEXT_CHARS}""")
def capped_short_texts(spark, sf_dir):
    """P13 after L3 (no cap): rows with summary and text, text shorter than 1500."""
    a = q_text.extracted_articles(spark, sf_dir).select("doc_id", "summary", "text")
    out = B.cap_then_filter(a, ["doc_id"], ["summary", "text"])
    return out.select("doc_id", F.length("text").cast("long").alias("text_chars"))


@register("cap_counters", f"""WITH {q_text._ART_SQL},
ok AS (SELECT doc_id, text FROM art
       WHERE summary IS NOT NULL AND text IS NOT NULL)
SELECT count(*) AS seen, count(*) FILTER (WHERE length(text) < {B.MAX_TEXT_CHARS}) AS accepted FROM ok""")
def cap_counters(spark, sf_dir):
    """A3: rows seen and rows accepted by the length test, in one pass (no cap)."""
    a = q_text.extracted_articles(spark, sf_dir).select("doc_id", "summary", "text")
    return B.cap_counters(a, ["doc_id"], ["summary", "text"])


@register("train_val_split", f"""SELECT doc_id,
  CASE WHEN {seeded_hash_sql('doc_id', SEED)} % 100 < {TRAIN_PCT} THEN 'train' ELSE 'validation' END AS split
FROM documents""")
def train_val_split(spark, sf_dir):
    """Seeded hash split, 90 % train."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return B.split_train_val(docs, "doc_id", SEED, TRAIN_PCT)


def _batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return B.shuffled_batches(docs, "doc_id", SEED, EPOCH)


@register("shuffled_batches", f"""WITH {_SHUF_SQL} SELECT batch_id, "row", doc_id FROM bat""")
def shuffled_batches(spark, sf_dir):
    """L5 + R6: seeded full shuffle, 32 consecutive rows per batch, short last batch kept."""
    return _batches(spark, sf_dir).select("batch_id", "row", "doc_id")


def _padded(spark, sf_dir):
    b = _batches(spark, sf_dir).withColumn("ids", word_length_ids())
    return B.pad_batch(b, "ids")


@register("padded_batches", f"""WITH {_PAD_SQL}
SELECT batch_id, "row", doc_id, seq_len, pad_len, {_wsum_sql('padded')} AS ids_wsum FROM p2""")
def padded_batches(spark, sf_dir):
    """Ids padded with 0 to the batch maximum (whole texts)."""
    p = _padded(spark, sf_dir)
    return p.select("batch_id", "row", "doc_id", F.size("ids").cast("long").alias("seq_len"), "pad_len",
                    B.weighted_sum("padded").alias("ids_wsum"))


@register("shift_mask", f"""WITH {_PAD_SQL},
sh AS (SELECT *, padded[1:pad_len - 1] AS inp, padded[2:pad_len] AS tar FROM p2)
SELECT batch_id, "row", doc_id, CAST(len(inp) AS BIGINT) AS inp_len, {_wsum_sql('inp')} AS inp_wsum,
       {_wsum_sql('tar')} AS tar_wsum,
       CAST(coalesce(list_sum(list_transform(inp, lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END)), 0) AS BIGINT) AS inp_pad
FROM sh""")
def shift_mask(spark, sf_dir):
    """R2 + R3: teacher-forcing shift of the padded row and its padding mask."""
    p = _padded(spark, sf_dir)
    inp, tar = B.shift("padded")
    p = p.withColumn("inp", inp).withColumn("tar", tar)
    mask = B.padding_mask("inp")
    return p.select("batch_id", "row", "doc_id", F.size("inp").cast("long").alias("inp_len"),
                    B.weighted_sum("inp").alias("inp_wsum"), B.weighted_sum("tar").alias("tar_wsum"),
                    F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("inp_pad"))


@register("mask_intervals", f"""WITH {_PAD_SQL},
z AS (SELECT *, pad_len - 1 AS n, list_filter(list_transform(padded[1:pad_len - 1], lambda x, i: CASE WHEN x = 0 THEN i END),
                                              lambda i: i IS NOT NULL) AS zeros FROM p2)
SELECT batch_id, "row", doc_id, n AS size, n * (n - 1) // 2 AS ahead_cells,
  CAST(n * (n - 1) // 2 + len(zeros) * (n + 1) - coalesce(list_sum(zeros), 0) AS BIGINT) AS masked_cells,
  CAST(CASE WHEN len(zeros) > 0 THEN zeros[1] - 1 END AS BIGINT) AS first_padding
FROM z""")
def mask_intervals(spark, sf_dir):
    """R4 + R5 over whole texts as intervals: cells masked ahead of each row, all masked cells, where padding starts."""
    p = _padded(spark, sf_dir).withColumn("m", B.mask_intervals(B.shift("padded")[0]))
    m = F.col("m")
    ahead = B.masked_cells(F.struct(m["size"].alias("size"), F.slice(m["runs"], 1, 0).alias("runs")))
    return p.select("batch_id", "row", "doc_id", m["size"].cast("long").alias("size"), ahead.alias("ahead_cells"),
                    B.masked_cells(m).alias("masked_cells"),
                    F.get(m["runs"], 0)["start"].cast("long").alias("first_padding"))


@register("running_mean", f"""WITH e AS (
  SELECT CAST(ts AS DATE) AS epoch, value,
         row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS batch FROM events),
r AS (SELECT epoch, batch, avg(value) OVER (PARTITION BY epoch ORDER BY batch
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_mean,
             max(batch) OVER (PARTITION BY epoch) AS last FROM e)
SELECT epoch, CAST(batch AS BIGINT) AS batch, running_mean FROM r
WHERE batch % {M.REPORT_EVERY} = 0 OR batch = last""")
def running_mean(spark, sf_dir):
    """Per-day (epoch) running mean of event values in time order, every 50th row and the last."""
    ev = table(spark, sf_dir, "events").select(F.to_date("ts").alias("epoch"), "ts", "event_id", "value")
    return M.running_mean_report(ev, "epoch", ["ts", "event_id"], "value")


_LOGITS_SQL = """t AS (
  SELECT CAST(floor(vec_id / 32) AS BIGINT) AS batch, CAST(label AS BIGINT) AS label,
         CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT batch, label, x, list_max(x) AS m FROM t),
v AS (SELECT batch, CASE WHEN label <> 0 THEN 1.0 ELSE 0.0 END AS mk,
        CASE WHEN label <> 0 THEN ln(list_sum(list_transform(x, lambda y: exp(y - m)))) + m - x[label + 1] ELSE 0.0 END AS l,
        CASE WHEN label <> 0 AND list_position(x, m) - 1 = label THEN 1.0 ELSE 0.0 END AS a FROM u)"""


@register("masked_metrics", f"""WITH {_LOGITS_SQL}
SELECT batch, sum(l) / sum(mk) AS loss, sum(a) / sum(mk) AS accuracy, CAST(sum(mk) AS BIGINT) AS tokens
FROM v GROUP BY batch""")
def masked_metrics(spark, sf_dir):
    """A7 + A8: masked cross-entropy and accuracy per batch (label 0 = padding).

    Stand-in predictions: each embedding row is one token's logits, its
    ``label`` the target, 32 consecutive ids a batch.
    """
    emb = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 32).cast("long").alias("batch"), F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("logits"))
    return M.masked_token_metrics(emb, ["batch"])


@register("lr_curve", f"""WITH {_SHUF_SQL},
steps AS (SELECT DISTINCT batch_id + 1 AS step FROM bat)
SELECT CAST(step AS BIGINT) AS step,
  (1.0 / sqrt({M.D_MODEL})) * least(pow(step, -0.5), step * pow({M.WARMUP_STEPS}, -1.5)) AS lr FROM steps""")
def lr_curve(spark, sf_dir):
    """warm-up then inverse-square-root learning rate at every training step (one per batch)."""
    steps = _batches(spark, sf_dir).select((F.col("batch_id") + 1).alias("step")).distinct()
    return steps.select(F.col("step").cast("long"), M.learning_rate("step").alias("lr"))


@register("positional_table", f"""WITH {_IDS_SQL},
mx AS (SELECT max(len(ids)) AS L FROM ids),
p AS (SELECT unnest(range(L)) AS pos FROM mx),
v AS (SELECT pos, i, CASE WHEN i % 2 = 0 THEN sin(pos / pow({M.POSITION_BASE}, (2 * (i // 2)) / {float(M.D_MODEL)}))
                           ELSE cos(pos / pow({M.POSITION_BASE}, (2 * (i // 2)) / {float(M.D_MODEL)})) END AS val
      FROM p, range({M.D_MODEL}) t(i))
SELECT CAST(pos AS BIGINT) AS pos, sum(val) AS total, max(CASE WHEN i = 0 THEN val END) AS first,
       max(CASE WHEN i = {M.D_MODEL - 1} THEN val END) AS last FROM v GROUP BY pos""")
def positional_table(spark, sf_dir):
    """sinusoidal encoding for every position up to the longest id row (512 wide)."""
    ids = table(spark, sf_dir, "documents").select(F.size(word_length_ids()).alias("n"))
    positions = ids.agg(F.max("n").alias("L")).select(F.explode(F.sequence(F.lit(0), F.col("L") - 1)).alias("pos"))
    pe = M.positional_long(positions.repartition(F.col("pos")))
    return pe.groupBy("pos").agg(F.sum("value").alias("total"),
                                 F.max(F.when(F.col("i") == 0, F.col("value"))).alias("first"),
                                 F.max(F.when(F.col("i") == M.D_MODEL - 1, F.col("value"))).alias("last"))
