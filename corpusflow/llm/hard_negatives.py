"""Hard-negative mining with Four-Russians scoring.

Vectors become integers.  A candidate is stored as its bit planes: bit b of
eight neighbouring dimensions is one byte.  For every anchor and every group of
eight dimensions a table holds the sums of all 256 subsets of the anchor's
eight entries, each made from a smaller one by one addition.  A candidate's
byte is the number of such a subset, so one lookup adds eight products of a
plane; the planes' sums, doubled and added from the sign plane down, are the
full inner product, exact.

The rows are packed once.  Anchors are taken in rounds of a bounded size that
is broadcast; a round's positives are found first, then the negatives in the
window that each positive's score sets.  No candidate is shuffled: a task walks
through one slab of the packed rows and keeps the best few of each anchor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick
from .vectors import finite, matrix

#: Bytes of anchors (planes, ids, positives) that a round may broadcast.
ROUND_BYTES = 64 << 20
#: Bytes of subset-sum tables that a task may hold, and anchors per table block.
TABLE_BYTES, BLOCK = 64 << 20, 512
#: Slabs of packed rows per group of anchors: each gives its best few, which are shuffled.
SLABS = 64
#: Candidates scored at once, and hits held before they are merged.
STEP, HELD = 256, 100_000
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")


def pack_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits, groups) bytes of integers in two's complement; bit i of a byte is dimension 8 * group + i."""
    n, dims = x.shape
    groups = -(-dims // 8)
    full = np.zeros((n, groups * 8), np.int64)
    full[:, :dims] = x
    planes = np.empty((n, bits, groups), np.uint8)
    for b in range(bits):
        planes[:, b] = np.packbits((full >> b & 1).astype(np.uint8), axis=1, bitorder="little")
    return planes


def unpack_planes(planes: np.ndarray) -> np.ndarray:
    """The integers of ``pack_planes`` (dimensions filled up to a multiple of eight)."""
    n, bits, groups = planes.shape
    out = np.zeros((n, groups * 8), np.int64)
    for b in range(bits):
        weight = -(1 << b) if b == bits - 1 else 1 << b
        out += np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(np.int64) * weight
    return out


def _holds(bound: int) -> type:
    return next(t for t in (np.int16, np.int32, np.int64) if bound <= np.iinfo(t).max)


def _within(bound: np.ndarray, kind: type) -> np.ndarray:
    """Bounds in the type of the scores; those beyond it go to its ends."""
    return np.clip(bound, np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)


class SubsetSums:
    """Tables of one block of anchors: entry [group][byte] has a sum for each anchor."""

    def __init__(self, anchors: np.ndarray, bits: int):
        bound = int(np.abs(anchors).sum(axis=1).max(initial=0))
        self.bits, self.plane, self.total = bits, _holds(bound), _holds(bound << bits)
        self.tables = []
        for g in range(0, anchors.shape[1], 8):
            t = np.zeros((256, len(anchors)), self.plane)
            for i in range(8):
                t[1 << i:2 << i] = t[:1 << i] + anchors[:, g + i].astype(self.plane)
            self.tables.append(t)

    def scores(self, planes: np.ndarray) -> np.ndarray:
        """(candidates, anchors): inner products by table lookups, shifts and additions."""
        n, bits, groups = planes.shape
        width = self.tables[0].shape[1]
        total = np.zeros((n, width), self.total)
        plane, found = np.empty((2, n, width), self.plane)
        for b in reversed(range(bits)):
            np.take(self.tables[0], planes[:, b, 0], axis=0, out=plane, mode="clip")
            for g in range(1, groups):
                np.take(self.tables[g], planes[:, b, g], axis=0, out=found, mode="clip")
                np.add(plane, found, out=plane)
            if b == bits - 1:
                np.subtract(total, plane, out=total)
            else:
                np.left_shift(total, 1, out=total)
                np.add(total, plane, out=total)
        return total


class Best:
    """The first ``size`` (score, id) of each of ``n`` keys: higher scores first, ties by smaller id."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), _LEAST)
        self.id = np.full((n, size), _MOST)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        full = self.score[key, -1]
        use = (score > full) | ((score == full) & (ids < self.id[key, -1]))
        key, score, ids = key[use], score[use].astype(np.int64), ids[use]
        own = np.unique(key)
        key = np.concatenate([np.repeat(own, self.size), key])
        score = np.concatenate([self.score[own].ravel(), score])
        ids = np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        begin = np.searchsorted(key, own)
        at = begin[:, None] + np.arange(self.size)
        self.score[own], self.id[own] = score[at], ids[at]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.score > _LEAST)
        return key, self.score[key, place], self.id[key, place]


@dataclass
class Anchors:
    """A round's anchors in order of label; ``low`` and ``high`` bound the scores wanted for each positive."""

    ids: np.ndarray
    labels: np.ndarray
    planes: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def part(self, a: int, b: int) -> "Anchors":
        return Anchors(*(None if x is None else x[a:b] for x in (self.ids, self.labels, self.planes, self.low, self.high)))


def _read(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
    flat = np.frombuffer(b"".join(batch.column("planes").to_pylist()), np.uint8)
    return ids, labels, flat.reshape(batch.num_rows, bits, -1)


def _emit(best: Best, first: int, per: int) -> pa.RecordBatch:
    key, score, ids = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(key + first * per, pa.int64()), pa.array(score), pa.array(ids)], names=["key", "score", "id"])


def _positives(part: Anchors, bits: int, first: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``size`` best other rows of each anchor's label."""
    best, tables = Best(len(part.ids), size), {}
    vectors = unpack_planes(part.planes)
    for batch in batches:
        ids, labels, planes = _read(batch, bits)
        for label in np.unique(labels):
            a, b = np.searchsorted(part.labels, [label, label + 1])
            rows = np.flatnonzero(labels == label)
            for lo in range(a, b, BLOCK):
                hi = min(b, lo + BLOCK)
                if lo not in tables:
                    tables[lo] = SubsetSums(vectors[lo:hi], bits)
                for at in range(0, len(rows), STEP):
                    some = rows[at:at + STEP]
                    s = tables[lo].scores(planes[some])
                    r, k = np.nonzero((s >= _within(best.score[lo:hi, -1], s.dtype.type)) & (ids[some][:, None] != part.ids[lo:hi]))
                    best.add(k + lo, s[r, k], ids[some[r]])
    yield _emit(best, first, 1)


def _negatives(part: Anchors, bits: int, first: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor and positive the ``size`` best rows of other labels with a score in the positive's window."""
    n, per = part.low.shape
    best, tables = Best(n * per, size), {}
    vectors = unpack_planes(part.planes)
    held: list[tuple[np.ndarray, ...]] = []

    def merge() -> None:
        if held:
            a, s, ids = (np.concatenate(x) for x in zip(*held))
            s = s.astype(np.int64)
            row, p = np.nonzero((s[:, None] >= part.low[a]) & (s[:, None] <= part.high[a]))
            best.add(a[row] * per + p, s[row], ids[row])
            held.clear()

    for batch in batches:
        ids, labels, planes = _read(batch, bits)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            if lo not in tables:
                tables[lo] = SubsetSums(vectors[lo:hi], bits)
            top = part.high[lo:hi].max(axis=1)
            if (top == _LEAST).all():
                continue
            floor, waiting = None, 0
            for at in range(0, len(ids), STEP):
                if floor is None:  # a score below what every window still takes is no hit
                    floor = np.maximum(part.low[lo:hi], best.score[lo * per:hi * per, -1].reshape(-1, per)).min(axis=1)
                s = tables[lo].scores(planes[at:at + STEP])
                r, k = np.nonzero((s >= _within(floor, s.dtype.type)) & (s <= _within(top, s.dtype.type)))
                other = labels[at + r] != part.labels[lo + k]
                r, k = r[other], k[other]
                held.append((k + lo, s[r, k], ids[at + r]))
                waiting += len(r)
                if waiting > HELD or not at:
                    merge()
                    floor, waiting = None, 0
            merge()
    yield _emit(best, first, per)


def _scan(pool: DataFrame, shared, cuts: list[tuple[int, int]], bits: int, size: int, what) -> DataFrame:
    """(key, score, id): the best of each slab, for every group of the round's anchors."""
    def of(a: int, b: int) -> DataFrame:
        return pool.mapInArrow(lambda batches: what(shared.value.part(a, b), bits, a, size, batches), "key bigint, score bigint, id bigint")

    return reduce(DataFrame.unionAll, [of(a, b) for a, b in cuts])


def _first(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of each key over all slabs, ranked from 1."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(rows: DataFrame, is_anchor: Column, *, id_col: str = "id", label_col: str = "label", vector_col: str = "vector", scale: int = 256,
         n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``is_anchor`` is an expression over column ``id``.  An entry x becomes
    floor(``scale`` * x); a score is the integer inner product with the anchor.
    Positives are the anchor's first ``n_positives`` rows of its label with
    another id, negatives the first ``n_negatives`` rows of other labels with
    ``low`` * positive_score <= 100 * negative_score <= ``high`` *
    positive_score; higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite entry,
    take no part.  Ids and labels are integers.  A vector with fewer entries
    than the longest is filled up with zeros.  Rows that repeat each count as
    candidates; an anchor that repeats whole gives its rows once, unlike
    anchors of one id each give theirs.  An anchor without positives or a
    positive without negatives gives no row; an empty table gives an empty
    result.  Scores must fit in a long.
    """
    spark = rows.sparkSession
    given = pick(rows, id=id_col, label=label_col, vector=vector_col).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    whole = given.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"),
                         F.transform("vector", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("x"))
    size = whole.agg(F.max(F.size("x")).alias("dims"), F.max(F.array_max("x")).alias("most"), F.min(F.array_min("x")).alias("least")).first()
    dims = size["dims"] or 0
    if not dims:
        return spark.createDataFrame([], RESULT)
    bits = max(int(size["most"]), -int(size["least"]) - 1, 0).bit_length() + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            planes = pack_planes(matrix(b.column("x"), dims), bits)
            data = pa.array([p.tobytes() for p in planes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), data], names=["id", "label", "planes"])

    pool = checkpoint(whole.mapInArrow(packed, "id bigint, label bigint, planes binary"))
    anchors = checkpoint(pool.where(is_anchor).distinct())
    groups = -(-dims // 8)
    rounds = max(1, math.ceil(anchors.count() * (bits * groups + 48 + 32 * n_positives) / round_bytes))
    together = max(BLOCK, TABLE_BYTES // (groups * 256 * 4) // BLOCK * BLOCK)
    slabs = pool.coalesce(SLABS)
    results = []
    for k in range(rounds):
        got = anchors.where(F.pmod(F.xxhash64("id", "planes", F.lit(7)), F.lit(rounds)) == k).orderBy("label", "id", "planes").toArrow()
        if not got.num_rows:
            continue
        ids, labels, planes = _read(got.combine_chunks().to_batches()[0], bits)
        own = Anchors(ids, labels, planes)
        cuts = [(a, min(len(ids), a + together)) for a in range(0, len(ids), together)]
        shared = spark.sparkContext.broadcast(own)  # at most about `round_bytes`
        found = _first(_scan(slabs, shared, cuts, bits, n_positives, _positives), n_positives).toArrow()  # rows of this round alone
        key, rank, score, pid = (found.column(c).to_numpy() for c in ("key", "rank", "score", "id"))
        own.low, own.high = np.full((len(ids), n_positives), _MOST), np.full((len(ids), n_positives), _LEAST)  # no positive: no score fits
        own.low[key, rank - 1], own.high[key, rank - 1] = -(-low * score // 100), high * score // 100
        positive = np.zeros((2, len(ids) * n_positives), np.int64)
        positive[:, key * n_positives + rank - 1] = pid, score
        wide = spark.sparkContext.broadcast(own)
        names = spark.sparkContext.broadcast((ids, positive))

        def named(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            ids, (pid, ps) = names.value
            for b in batches:
                key = b.column("key").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[key // n_positives]), pa.array(pid[key]), b.column("rank"), b.column("id"), pa.array(ps[key]), b.column("score")],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        best = _first(_scan(slabs, wide, cuts, bits, n_negatives, _negatives), n_negatives)
        results.append(checkpoint(best.mapInArrow(named, RESULT)))
        for b in (shared, wide, names):
            b.unpersist()
    return reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], RESULT)


#: DuckDB SQL for the rows of query ``op11_hard_negatives``.
SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, c.id AS id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a, e c WHERE a.id % 100 = 0 AND a.id <> c.id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
