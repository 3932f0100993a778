"""Training metrics and schedules as data jobs.

* W6 running mean per epoch, reported every 50 batches and at the epoch's
  last batch; the running sums use the distributed prefix-sum plan, so an
  epoch with a third of all rows is still spread over many tasks.
* A7 masked cross-entropy and A8 masked accuracy from (label, logits) rows:
  ``sum(loss * mask) / sum(mask)`` with mask = label <> 0; ties in argmax go
  to the first maximum.
* A9 in-batch contrastive loss (logits = scale x cosine, target = own row;
  symmetric for pairs, one-way against 2B candidates for triples): one Arrow
  group per batch, bounded by the batch size.
* F13 learning-rate curve and F14 sinusoidal position table: column math.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.ordinals import running_totals

# fixed values of the training loop: report interval, model width, warm-up,
# contrastive scale
REPORT_EVERY = 50
D_MODEL = 512
WARMUP_STEPS = 4000
CONTRASTIVE_SCALE = 20.0
POSITION_BASE = 10000.0


def running_mean_report(df: DataFrame, epoch_col: str, order_by, value_col: str,
                        every: int = REPORT_EVERY) -> DataFrame:
    """``epoch, batch, running_mean`` at batches ``batch % every == 0`` and each epoch's last batch."""
    run = running_totals(df.select(epoch_col, *order_by, value_col), [value_col], list(order_by), partition_by=[epoch_col])
    run = run.withColumn("batch", (F.col("cum_count") - 1).cast("long"))
    last = df.groupBy(epoch_col).agg((F.count(F.lit(1)) - 1).alias("_last"))
    out = run.join(last, epoch_col)
    return (out.where((F.pmod(F.col("batch"), F.lit(every)) == 0) | (F.col("batch") == F.col("_last")))
            .select(epoch_col, "batch", (F.col(f"cum_{value_col}") / F.col("cum_count")).alias("running_mean")))


def token_loss(label: str | Column, logits: str | Column) -> Column:
    """A7 per token: ``logsumexp(logits) - logits[label]`` in double."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    lb = F.col(label) if isinstance(label, str) else label
    x = F.transform(lg, lambda v: v.cast("double"))
    m = F.array_max(x)
    lse = F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, v: a + v)) + m
    return lse - F.get(x, lb.cast("int"))


def token_argmax(logits: str | Column) -> Column:
    """Index of the first maximum."""
    lg = F.col(logits) if isinstance(logits, str) else logits
    x = F.transform(lg, lambda v: v.cast("double"))
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def masked_token_metrics(df: DataFrame, group_cols, label_col: str = "label",
                         logits_col: str = "logits") -> DataFrame:
    """A7 + A8 per group: ``loss``, ``accuracy``, ``tokens`` over non-padding labels (null, null, 0 if all are padding)."""
    mask = (F.col(label_col) != 0).cast("double")
    per = df.select(*group_cols, mask.alias("_m"),
                    F.when(F.col(label_col) != 0, token_loss(label_col, logits_col)).otherwise(0.0).alias("_l"),
                    ((token_argmax(logits_col) == F.col(label_col)) & (F.col(label_col) != 0))
                    .cast("double").alias("_a"))
    return (per.groupBy(*group_cols)
            .agg(F.try_divide(F.sum("_l"), F.sum("_m")).alias("loss"), F.try_divide(F.sum("_a"), F.sum("_m")).alias("accuracy"),
                 F.sum("_m").cast("long").alias("tokens")))


#: Vectors of a batch that a task scores against each other; a larger batch is cut into pairs of blocks.
BLOCK = 2048
_PART = "batch_id bigint, way int, row bigint, most double, total double"
_ANCHOR, _POSITIVE, _NEGATIVE = 0, 1, 2
#: What a row of ``_PART`` is about: an anchor over candidates, a positive over anchors, an anchor's own score.
_FORWARD, _BACKWARD, _OWN = 0, 1, 2


def _tile(scale: float, symmetric: bool):
    """Partial log-sum-exp (largest score, sum of exponentials below it) of one block of anchors over one of candidates."""
    def unit(vectors) -> np.ndarray:
        v = np.stack(vectors.to_numpy()).astype(np.float64)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, c = pdf[pdf["kind"] == _ANCHOR], pdf[pdf["kind"] != _ANCHOR]
        parts: list[tuple] = []

        def add(way: int, rows, most, total) -> None:
            parts.append((np.full(len(rows), way, np.int32), rows, most, total))

        if len(a) and len(c):
            s = scale * unit(a["vec"]) @ unit(c["vec"]).T
            rows, cand = a["row"].to_numpy(np.int64), c["row"].to_numpy(np.int64)
            most = s.max(axis=1)
            add(_FORWARD, rows, most, np.exp(s - most[:, None]).sum(axis=1))
            if symmetric:
                most = s.max(axis=0)
                add(_BACKWARD, cand, most, np.exp(s - most).sum(axis=0))
            positive = np.flatnonzero(c["kind"].to_numpy() == _POSITIVE)
            _, i, j = np.intersect1d(rows, cand[positive], return_indices=True)
            add(_OWN, rows[i], s[i, positive[j]], np.zeros(len(i)))
        way, row, most, total = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0),) * 4
        return pd.DataFrame({"batch_id": np.full(len(way), int(pdf["batch_id"].iloc[0])), "way": way, "row": row, "most": most, "total": total})
    return run


def in_batch_contrastive(df: DataFrame, batch_col: str = "batch_id", row_col: str = "row",
                         anchor: str = "anchor", positive: str = "positive", negative: str | None = None,
                         scale: float = CONTRASTIVE_SCALE, block: int = BLOCK) -> DataFrame:
    """A9 per batch: ``batch_id, rows, loss``; ``row`` names a row of its batch.

    Blocks of anchors meet blocks of candidates (``explode`` of block numbers,
    no join of rows); each pair of blocks gives one partial log-sum-exp per row,
    and these are merged by row.  No task holds more than two blocks, however
    large a batch is.
    """
    rows = df.select(F.col(batch_col).cast("long").alias("batch_id"), F.col(row_col).cast("long").alias("row"),
                     F.col(anchor).alias("a"), F.col(positive).alias("p"), *([F.col(negative).alias("n")] if negative else []))
    # a row per batch that is larger than a block: at most rows / block
    large = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
    large = large.select("batch_id", F.ceil(F.col("size") / block).cast("int").alias("nb"))
    rows = (rows.join(large, "batch_id", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
            .withColumn("blk", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int")))

    kinds = dict(rows.dtypes)
    kept = "array<float>" if all(kinds[c] == "array<float>" for c in "apn" if c in kinds) else "array<double>"  # _tile widens them

    def copies(kind: int, vec: str):
        def one(k):
            i, j = (F.col("blk"), k) if kind == _ANCHOR else (k, F.col("blk"))
            return F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), F.col(vec).cast(kept).alias("vec"))
        return F.transform(F.sequence(F.lit(0), F.col("nb") - 1), one)

    sides = [copies(_ANCHOR, "a"), copies(_POSITIVE, "p"), *([copies(_NEGATIVE, "n")] if negative else [])]
    spread = rows.select("batch_id", "row", F.explode(F.concat(*sides)).alias("x")).select("batch_id", "row", "x.i", "x.j", "x.kind", "x.vec")
    parts = spread.groupBy("batch_id", "i", "j").applyInPandas(_tile(float(scale), negative is None), _PART)
    # merge: one part per block of the other side
    merged = parts.groupBy("batch_id", "way", "row").agg(F.collect_list(F.struct("most", "total")).alias("parts"))
    top = F.array_max(F.transform("parts", lambda x: x["most"]))
    merged = merged.withColumn("top", top).withColumn("lse", F.when(F.col("way") == _OWN, F.col("top")).otherwise(
        F.col("top") + F.log(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["total"] * F.exp(x["most"] - F.col("top"))))))
    total = lambda way: F.sum(F.when(F.col("way") == way, F.col("lse")))
    sums = merged.groupBy("batch_id").agg(F.count_if(F.col("way") == _FORWARD).alias("rows"), total(_FORWARD).alias("f"),
                                          total(_BACKWARD).alias("b"), total(_OWN).alias("o"))
    loss = (F.col("f") - F.col("o")) / F.col("rows")
    if negative is None:
        loss = (loss + (F.col("b") - F.col("o")) / F.col("rows")) / 2
    return sums.select("batch_id", "rows", loss.alias("loss"))



def learning_rate(step: str | Column, d_model: int = D_MODEL, warmup: int = WARMUP_STEPS) -> Column:
    """``d^-0.5 * min(step^-0.5, step * warmup^-1.5)``."""
    s = (F.col(step) if isinstance(step, str) else step).cast("double")
    return F.lit(1.0 / math.sqrt(d_model)) * F.least(F.pow(s, -0.5), s * F.lit(warmup ** -1.5))


def positional_encoding(pos: str | Column, d_model: int = D_MODEL) -> Column:
    """``angle = pos / 10000^(2*(i div 2)/d)``; sin on even ``i``, cos on odd ``i``."""
    p = (F.col(pos) if isinstance(pos, str) else pos).cast("double")
    idx = F.sequence(F.lit(0), F.lit(d_model - 1))

    def val(i):
        angle = p / F.pow(F.lit(POSITION_BASE), (F.lit(2) * F.floor(i / 2)).cast("double") / F.lit(float(d_model)))
        return F.when(F.pmod(i, F.lit(2)) == 0, F.sin(angle)).otherwise(F.cos(angle))

    return F.transform(idx, val)


def positional_long(positions: DataFrame, pos_col: str = "pos", d_model: int = D_MODEL) -> DataFrame:
    """F14 in long form ``pos, i, value`` (M15): one row per (position, dimension), whole-stage codegen."""
    x = positions.select(F.col(pos_col).cast("long").alias("pos"),
                         F.explode(F.sequence(F.lit(0), F.lit(d_model - 1))).alias("i"))
    angle = F.col("pos").cast("double") / F.pow(F.lit(POSITION_BASE),
                                                (F.lit(2) * F.floor(F.col("i") / 2)).cast("double") / F.lit(float(d_model)))
    return x.select("pos", "i", F.when(F.pmod("i", F.lit(2)) == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))
