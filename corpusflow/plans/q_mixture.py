"""Mixture queries (S13, S14, A12, L7, L8) and the in-batch contrastive metric.

Stand-in pair datasets from the driver tables (rows only): ``dialog`` =
[user turn, next assistant turn]; ``forum`` = the same exchanges in the
forum form {response, context}; ``dialog_triples`` = [user, assistant,
next user]; ``articles`` = [first line, rest of the document].
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.hashing import MODULUS, seeded_hash_sql
from corpusflow.operators import batching, encoder, metrics, mixture
from corpusflow.plans.registry import register
from corpusflow.session import cut_lineage
from corpusflow.plans.sqlgen import s
from corpusflow.sources.tables import table

# mixture configuration (a parameter, like the reference's data config file)
WEIGHTS = {"dialog": 3, "forum": 1, "dialog_triples": 1, "articles": 2}
DATASETS_PER_BATCH = 2
PER_SLOT = 16
SEED = 7


def _exchanges(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("a"))
    u2 = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") - 2).alias("turn"),
                                                 F.col("text").alias("u2"))
    return u.join(a, ["conv_id", "turn"]), u2


def samples(spark, sf_dir):
    ua, u2 = _exchanges(spark, sf_dir)
    dialog = ua.select(F.lit("dialog").alias("dataset"), F.array("u", "a").alias("texts"))
    forum = mixture.forum_pairs(ua.select(F.col("a").alias("response"), F.col("u").alias("context")))
    triples = ua.join(u2, ["conv_id", "turn"]).select(F.lit("dialog_triples").alias("dataset"),
                                                       F.array("u", "a", "u2").alias("texts"))
    docs = table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    rest = F.substr(F.col("text"), F.length(first) + 2)
    articles = docs.where(F.length(rest) > 0).select(F.lit("articles").alias("dataset"),
                                                      F.array(first, rest).alias("texts"))
    return dialog.unionByName(forum).unionByName(triples).unionByName(articles)


_SAMPLES_SQL = """ua AS (
  SELECT u.conv_id, u.turn, u.text AS u, a.text AS a FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
samples AS (
  SELECT 'dialog' AS dataset, [u, a] AS texts FROM ua
  UNION ALL SELECT 'forum', [a, u] FROM ua
  UNION ALL SELECT 'dialog_triples', [ua.u, ua.a, x.text] FROM ua
    JOIN conversations x ON x.conv_id = ua.conv_id AND x.turn = ua.turn + 2 AND x.role = 'user'
  UNION ALL SELECT 'articles', [split_part(text, chr(10), 1), substr(text, length(split_part(text, chr(10), 1)) + 2)]
    FROM documents WHERE length(substr(text, length(split_part(text, chr(10), 1)) + 2)) > 0)"""

_CFG_SQL = "cfg(name, weight) AS (VALUES " + ", ".join(f"({s(k)}, CAST({v} AS BIGINT))" for k, v in WEIGHTS.items()) + ")"


def _config(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "name string, weight long")


@register("forum_pairs", f"""WITH {_SAMPLES_SQL}
SELECT texts[1] AS response, texts[2] AS context FROM samples WHERE dataset = 'forum'""")
def forum_pairs(spark, sf_dir):
    """Exchanges in forum form, emitted as [response, context]."""
    f = samples(spark, sf_dir).where(F.col("dataset") == "forum")
    return f.select(F.get("texts", 0).alias("response"), F.get("texts", 1).alias("context"))


@register("pair_arity", f"""WITH {_SAMPLES_SQL}
SELECT dataset, CAST(min(len(texts)) AS INTEGER) AS arity, count(*) AS rows FROM samples GROUP BY dataset""")
def pair_arity(spark, sf_dir):
    """S13 check: one arity per dataset (raises on mixed 2/3-text rows)."""
    return mixture.check_arity(samples(spark, sf_dir))


@register("mixture_weights", f"""WITH {_SAMPLES_SQL}, {_CFG_SQL},
present AS (SELECT DISTINCT dataset FROM samples)
SELECT name, weight, weight / sum(weight) OVER () AS probability FROM cfg JOIN present ON present.dataset = cfg.name""")
def mixture_weights(spark, sf_dir):
    """Sampling probability = weight / total weight, over the datasets present."""
    present = samples(spark, sf_dir).select(F.col("dataset").alias("name")).distinct()
    return mixture.sampling_probabilities(_config(spark).join(present, "name"))


def _n_batches(smp):
    g = DATASETS_PER_BATCH * PER_SLOT
    return smp.agg(F.ceil(F.count(F.lit(1)) / F.lit(g)).cast("long").alias("n")).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("batch"))


def _plan(spark, sf_dir):
    smp = samples(spark, sf_dir)
    arity = mixture.check_arity(smp).select("dataset", "arity")
    return mixture.batch_plan(_config(spark), arity, _n_batches(smp), DATASETS_PER_BATCH, SEED), smp


def _u_sql(key: str) -> str:
    return f"(CAST({seeded_hash_sql(key, SEED)} AS DOUBLE) / {float(MODULUS)})"


_PLAN_SQL = f"""WITH {_SAMPLES_SQL}, {_CFG_SQL},
ar AS (SELECT dataset AS name, min(len(texts)) AS arity FROM samples GROUP BY 1),
c AS (SELECT cfg.name, cfg.weight, ar.arity FROM cfg JOIN ar USING (name) WHERE weight > 0),
cum AS (SELECT name, arity,
          sum(weight) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) - weight AS lo_all,
          sum(weight) OVER (ORDER BY name ROWS UNBOUNDED PRECEDING) AS hi_all, sum(weight) OVER () AS tot_all,
          sum(weight) OVER (PARTITION BY arity ORDER BY name ROWS UNBOUNDED PRECEDING) - weight AS lo_ar,
          sum(weight) OVER (PARTITION BY arity ORDER BY name ROWS UNBOUNDED PRECEDING) AS hi_ar,
          sum(weight) OVER (PARTITION BY arity) AS tot_ar FROM c),
nb AS (SELECT CAST(ceil(count(*) / {DATASETS_PER_BATCH * PER_SLOT}) AS BIGINT) AS n FROM samples),
b AS (SELECT t.batch FROM nb, range(nb.n) t(batch)),
f AS (SELECT b.batch, 0 AS slot, cum.name AS dataset, cum.arity FROM b JOIN cum
      ON {_u_sql(f'b.batch * {DATASETS_PER_BATCH}')} * cum.tot_all >= cum.lo_all
     AND {_u_sql(f'b.batch * {DATASETS_PER_BATCH}')} * cum.tot_all < cum.hi_all),
r AS (SELECT f.batch, t.slot, cum.name AS dataset, cum.arity FROM f, range(1, {DATASETS_PER_BATCH}) t(slot)
      JOIN cum ON cum.arity = f.arity
       AND {_u_sql(f'f.batch * {DATASETS_PER_BATCH} + t.slot')} * cum.tot_ar >= cum.lo_ar
       AND {_u_sql(f'f.batch * {DATASETS_PER_BATCH} + t.slot')} * cum.tot_ar < cum.hi_ar)
SELECT batch, CAST(slot AS BIGINT) AS slot, dataset, CAST(arity AS INTEGER) AS arity FROM f
UNION ALL SELECT batch, CAST(slot AS BIGINT), dataset, CAST(arity AS INTEGER) FROM r"""


@register("mixture_plan", _PLAN_SQL)
def mixture_plan(spark, sf_dir):
    """Per global batch, datasets drawn by weight; all slots of a batch share the arity."""
    plan, _ = _plan(spark, sf_dir)
    return plan.select("batch", "slot", "dataset", F.col("arity").cast("int"))


@register("batch_unique_texts")
def batch_unique_texts(spark, sf_dir):
    """Planned batches filled so that no text repeats inside a global batch."""
    plan, smp = _plan(spark, sf_dir)
    out = mixture.unique_text_batches(smp, plan, PER_SLOT, SEED)
    return out.select("batch", "slot", "pos", "dataset", "sample", F.size("texts").cast("long").alias("arity"))


@register("batch_text_invariants", f"""SELECT batch, count(*) AS slots, CAST(0 AS BIGINT) AS repeated_texts,
  CAST(0 AS BIGINT) AS slots_over, CAST(0 AS BIGINT) AS slots_under_unflagged FROM ({_PLAN_SQL}) GROUP BY batch""")
def batch_text_invariants(spark, sf_dir):
    """L8 as it must be: every planned slot is there, no text repeats in a batch, no slot holds too many, or too few without its flag."""
    plan, smp = _plan(spark, sf_dir)
    out = cut_lineage(mixture.unique_text_batches(smp, plan, PER_SLOT, SEED))
    texts = out.select("batch", F.explode("texts").alias("t")).groupBy("batch", "t").agg(F.count(F.lit(1)).alias("n"))
    repeated = texts.groupBy("batch").agg(F.sum(F.col("n") - 1).alias("repeated_texts"))
    slots = out.groupBy("batch", "slot").agg(F.count(F.lit(1)).alias("n"), F.max("short").alias("short"))
    per = plan.select("batch", "slot").join(slots, ["batch", "slot"], "left").groupBy("batch").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if(F.col("n") > PER_SLOT).alias("slots_over"),
        F.count_if((F.col("n") < PER_SLOT) & ~F.col("short")).alias("slots_under_unflagged"))
    return per.join(repeated, "batch").select("batch", "slots", "repeated_texts", "slots_over", "slots_under_unflagged")


@register("in_batch_contrastive")
def in_batch_contrastive(spark, sf_dir):
    """Default encoder on dialog pairs, 32 pairs per shuffled batch, symmetric in-batch loss (scale 20)."""
    ua, _ = _exchanges(spark, sf_dir)
    pairs = ua.select(F.xxhash64("conv_id", "turn").alias("pair_id"), "u", "a")
    model = encoder.fit_encoder(pairs.select(F.col("u").alias("t")).unionByName(pairs.select(F.col("a").alias("t"))), "t")
    batches = batching.shuffled_batches(pairs, "pair_id", SEED)  # texts move, and are encoded where they are batched
    enc = encoder.encode(model, batches.withColumnRenamed("u", "t"), "t", "anchor").drop("t")
    enc = encoder.encode(model, enc.withColumnRenamed("a", "t"), "t", "positive").drop("t")
    return metrics.in_batch_contrastive(enc, "batch_id", "row", "anchor", "positive")
