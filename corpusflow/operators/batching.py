"""Training input shaping as column expressions and ordinals.

* L3 cap: with an explicit ``cap``, the first ``cap`` rows (load order) having
  both fields, *then* the length test - the cap counts rows the length test
  later drops.  By default there is no cap.
* L5 shuffle: order by a seeded hash of the id (per epoch); stable per seed.
* L6 split: ``hash mod 100 < train_pct``.
* R6 batches: consecutive rows of the shuffled order, ``batch_size`` per
  batch, last short batch kept.  Ordinals come from the distributed W4 plan.
* R1 pad to the batch maximum, R2 shift (on the padded row), R3-R5 masks.

Windows here are partitioned by ``batch_id`` only: a group is one batch
(at most ``batch_size`` rows), never a growing key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.hashing import seeded_hash
from corpusflow.operators.ordinals import with_ordinal

# fixed values of the training input: batch size and text length bound
BATCH_SIZE = 32
MAX_TEXT_CHARS = 1500


def first_rows(df: DataFrame, order_by: Sequence[str], required: Sequence[str], cap: int | None) -> DataFrame:
    """Rows with all ``required`` fields; with a ``cap``, the first ``cap`` of them by ``order_by`` (a unique key).

    Only the order keys are numbered (distributed ordinals); the rows are
    semi-joined on them, at every size by the same plan.
    """
    ok = df
    for c in required:
        ok = ok.where(F.col(c).isNotNull())
    if cap is None:
        return ok
    keys = list(order_by)
    numbered = with_ordinal(ok.select(*keys), keys, name="_cap_ordinal")
    return ok.join(numbered.where(F.col("_cap_ordinal") < cap).select(*keys), keys, "left_semi")


def cap_then_filter(df: DataFrame, order_by: Sequence[str], required: Sequence[str], cap: int | None = None,
                    text_col: str = "text", max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """L3 + P13: :func:`first_rows` (all of them by default), then ``len(text) < max_chars``."""
    return first_rows(df, order_by, required, cap).where(F.length(text_col) < max_chars)


def cap_counters(df: DataFrame, order_by: Sequence[str], required: Sequence[str], cap: int | None = None,
                 text_col: str = "text", max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """A3: ``seen`` (rows of :func:`first_rows`) and ``accepted`` (of those, short enough), one pass."""
    return first_rows(df, order_by, required, cap).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.length(text_col) < max_chars).alias("accepted"))


def split_train_val(df: DataFrame, id_col: str, seed: int = 0, train_pct: int = 90) -> DataFrame:
    """Deterministic hash split; adds ``split`` = ``train`` / ``validation``."""
    bucket = F.pmod(seeded_hash(id_col, seed), F.lit(100))
    return df.withColumn("split", F.when(bucket < train_pct, "train").otherwise("validation"))


def shuffle_key(id_col: str, seed: int = 0, epoch: int | Column = 0) -> Column:
    """The shuffled position key for ``epoch`` (seed and epoch folded into the hash)."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return seeded_hash(id_col, F.lit(seed).cast("long") * 1000003 + e.cast("long"))


def shuffled_batches(df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0,
                     batch_size: int = BATCH_SIZE) -> DataFrame:
    """L5 + R6: ``batch_id``, ``row`` (position in batch) over the shuffled order of the unique ``id_col``.

    Only ids are shuffled and numbered; the other columns join their place.
    """
    ids = df.select(id_col).withColumn("_shuffle", shuffle_key(id_col, seed, epoch))
    numbered = with_ordinal(ids, ["_shuffle", id_col], name="_ord")
    placed = numbered.select(id_col, F.floor(F.col("_ord") / batch_size).cast("long").alias("batch_id"),
                             F.pmod(F.col("_ord"), F.lit(batch_size)).cast("long").alias("row"))
    rest = [c for c in df.columns if c != id_col]
    return df.join(placed, id_col).select(id_col, *rest, "batch_id", "row") if rest else placed


def pad_batch(df: DataFrame, ids_col: str, batch_col: str = "batch_id", out_col: str = "padded") -> DataFrame:
    """Pad ``ids`` with 0 to the longest row of its batch; adds ``pad_len``."""
    w = Window.partitionBy(batch_col)
    with_len = df.withColumn("pad_len", F.max(F.size(ids_col)).over(w).cast("long"))
    pad = F.array_repeat(F.lit(0).cast("long"), (F.col("pad_len") - F.size(ids_col)).cast("int"))
    return with_len.withColumn(out_col, F.concat(F.col(ids_col).cast("array<bigint>"), pad))


def shift(padded: str | Column) -> tuple[Column, Column]:
    """R2: (input, target) = (all but last, all but first) of the padded row."""
    p = F.col(padded) if isinstance(padded, str) else padded
    n = F.size(p)
    return (F.slice(p, 1, F.greatest(n - 1, F.lit(0))),
            F.slice(p, F.least(F.lit(2), F.greatest(n, F.lit(1))), F.greatest(n - 1, F.lit(0))))


def padding_mask(ids: str | Column) -> Column:
    """1 where the id is padding (0), else 0."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.transform(c, lambda x: F.when(x == 0, 1).otherwise(0))


def look_ahead_mask(size: Column) -> Column:
    """``size`` x ``size`` matrix, 1 strictly above the diagonal."""
    idx = F.sequence(F.lit(0), size - 1)
    return F.transform(idx, lambda i: F.transform(idx, lambda j: F.when(j > i, 1).otherwise(0)))


def combined_mask(ids: str | Column) -> Column:
    """Element-wise max of the padding mask (per column) and the look-ahead mask."""
    c = F.col(ids) if isinstance(ids, str) else ids
    pad = padding_mask(c)
    idx = F.sequence(F.lit(0), F.size(c) - 1)
    return F.transform(idx, lambda i: F.transform(
        idx, lambda j: F.greatest(F.element_at(pad, j + 1), F.when(j > i, 1).otherwise(0))))


def padding_runs(ids: str | Column) -> Column:
    """R3 as intervals: ``array<struct<start, stop>>`` of the maximal runs of padding, ``stop`` exclusive.

    Padding at the end alone is found by whole-array built-ins; a row with
    padding elsewhere is looked at element by element.
    """
    c = F.col(ids) if isinstance(ids, str) else ids
    zero = F.lit(0).cast("long")
    first = F.array_position(c, zero).cast("int")
    run = F.struct((first - 1).alias("start"), F.size(c).alias("stop"))
    none = F.filter(F.array(run), lambda r: r["start"] >= 0)
    tail = F.slice(c, F.greatest(first, F.lit(1)), F.size(c))
    return F.when(first == 0, none).when(F.size(F.array_remove(tail, zero)) == 0, F.array(run)).otherwise(_any_padding_runs(c))


def _any_padding_runs(c: Column) -> Column:
    one, n = F.array(F.lit(1).cast("long")), F.size(c)
    wide = F.transform(c, lambda x: x.cast("long"))
    before = F.concat(one, F.slice(wide, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(wide, 2, F.greatest(n - 1, F.lit(0))), one)

    def places(other: Column, add: int) -> Column:
        """Where a row is padding and the neighbour is not; whole arrays at a time, so linear."""
        edge = F.zip_with(wide, other, lambda x, y: (x == 0) & (y != 0))
        return F.filter(F.transform(edge, lambda e, i: F.when(e, i + add)), lambda i: i.isNotNull())

    starts, stops = places(before, 0), places(after, 1)
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def mask_intervals(ids: str | Column) -> Column:
    """R4 + R5 in linear size: ``struct<size, runs>``.

    Row i of the combined mask is masked from column i + 1 on (R4) and in each
    of ``runs`` (R3); ``combined_row`` expands one row where it is used.
    """
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.struct(F.size(c).alias("size"), padding_runs(c).alias("runs"))


def combined_row(mask: Column, i: Column) -> Column:
    """Row ``i`` of the combined mask from its intervals; R4 with empty ``runs``."""
    idx = F.filter(F.sequence(F.lit(0), mask["size"]), lambda j: j < mask["size"])
    return F.transform(idx, lambda j: F.when((j > i) | F.exists(mask["runs"], lambda r: (j >= r["start"]) & (j < r["stop"])), 1).otherwise(0))


def masked_cells(mask: Column) -> Column:
    """Masked cells of the whole matrix: above the diagonal, and padding columns on and below it."""
    n = mask["size"].cast("long")
    # column j is padding for the rows j, ..., n - 1: n - j cells on and below the diagonal
    run = lambda r: (r["stop"] - r["start"]).cast("long") * (2 * n - r["start"] - r["stop"] + 1) / 2
    return (n * (n - 1) / 2 + F.aggregate(mask["runs"], F.lit(0.0), lambda a, r: a + run(r))).cast("long")


def weighted_sum(arr: str | Column) -> Column:
    """Checksum of an id array: sum of ``id * (position + 1)`` (compares whole arrays cheaply)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(F.transform(c, lambda x, i: x.cast("long") * (i + 1).cast("long")),
                       F.lit(0).cast("long"), lambda acc, x: acc + x)
