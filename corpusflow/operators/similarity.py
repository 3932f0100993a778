"""Exact cosine self-join inside windows, blocked so no task holds more than two blocks.

A window with more than a block of vectors is cut into cells: each vector
goes to the nearest of some pivots (rows of the window), and a cell that is
still too large into blocks by a hash.  Blocks grow with the window up to a
bounded size, so that a row is part of a bounded number of pairs.  Two vectors of cells with pivots p and
q are at an angle of at least angle(p, q) less the cells' radii, so block pairs
whose least angle is over that of the threshold hold no pair and are never
made.  Rows are replicated once per block pair that is left (a join with the
table of block pairs).  One Arrow group = one block pair; numpy computes tiles
of dot products and emits only pairs at or above the threshold, as float64 has
them, or only counts them (:func:`neighbour_counts`).

Vectors that lie in clusters skip most block pairs; where nothing can be
skipped the work stays quadratic inside a window (the reference compares every
pair of a two-day window), spread over all block pairs.  The approximate
alternative :func:`lsh_edges` trades exactness for sub-quadratic work.

Output: ``window_id, src, dst, score`` with both directions and the self pair
(score of a vector with itself), as the community step expects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.vectors import dot
from corpusflow.session import cut_lineage

EDGE_SCHEMA = T.StructType([
    T.StructField("window_id", T.LongType()),
    T.StructField("src", T.LongType()),
    T.StructField("dst", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

_TILE = 256, 1024  # rows and columns of a numpy tile inside one block pair (1 MB in single precision: stays in a core's cache)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length (no nulls) as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else 0)


def hits(left: np.ndarray, right: np.ndarray, threshold: float, scores: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows, columns, dot products) of the pairs at or above the threshold in double precision, tile by tile.

    A product in single precision finds the pairs; those within its error of the
    threshold, or all if their scores are asked for, are made again in double.
    """
    if not len(left) or not len(right):
        return
    with np.errstate(all="ignore"):
        reach = np.fmax.reduce(np.linalg.norm(left, axis=1)) * np.fmax.reduce(np.linalg.norm(right, axis=1))
    kind = np.float32 if np.isfinite(reach) and 1e-30 < reach < 1e30 else np.float64
    error = 4 * (left.shape[1] + 4) * float(np.finfo(kind).eps) * (reach if np.isfinite(reach) else 0.0)
    a, b = left.astype(kind), right.astype(kind)
    for i in range(0, len(a), _TILE[0]):
        for j in range(0, len(b), _TILE[1]):
            tile = a[i:i + _TILE[0]] @ b[j:j + _TILE[1]].T
            flat = np.flatnonzero(tile >= kind(threshold - error))
            if not len(flat):
                continue
            rows, cols = np.divmod(flat, tile.shape[1])
            again = np.arange(len(flat)) if scores else np.flatnonzero(tile.ravel()[flat] <= kind(threshold + error))
            exact = np.empty(len(again))
            for k in range(0, len(again), 1 << 16):
                at = again[k:k + (1 << 16)]
                exact[k:k + (1 << 16)] = np.einsum("ij,ij->i", left[rows[at] + i], right[cols[at] + j])
            keep = np.ones(len(flat), bool)
            keep[again] = exact >= threshold
            yield rows[keep] + i, cols[keep] + j, exact[keep] if scores else None


def _sides(table: pa.Table) -> tuple[int, bool, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Window, whether the pair is one block against itself, and (ids, numbers, vectors) of both blocks."""
    window, lo, hi = (table.column(c)[0].as_py() for c in ("window_id", "b_lo", "b_hi"))
    blk, ids, n = (table.column(c).to_numpy() for c in ("blk", "id", "n"))
    vectors = matrix(table.column("vec"))
    sides = [(ids[blk == k], n[blk == k], vectors[blk == k]) for k in ((lo,) if lo == hi else (lo, hi))]
    return window, lo == hi, [sides[0], sides[-1]]


def _block_pair_edges(threshold: float, include_self: bool):
    def run(table: pa.Table) -> pa.Table:
        window, same, ((li, _, lv), (ri, _, rv)) = _sides(table)
        out: list[tuple[np.ndarray, ...]] = []
        for rows, cols, scores in hits(lv, rv, threshold):
            if same and not include_self:
                rows, cols, scores = (x[rows != cols] for x in (rows, cols, scores))
            out.append((li[rows], ri[cols], scores))
            if not same:
                out.append((ri[cols], li[rows], scores))
        src, dst, score = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"window_id": np.full(len(src), window, np.int64), "src": src, "dst": dst, "score": score})
    return run


def _block_pair_counts(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        window, same, ((li, ln, lv), (ri, rn, rv)) = _sides(table)
        totals = [np.zeros((2, len(x)), np.int64) for x in (li, ri)]

        def add(total: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
            total[0] += np.bincount(at, minlength=total.shape[1])
            total[1] += np.bincount(at, weights=n, minlength=total.shape[1]).astype(np.int64)

        for rows, cols, _ in hits(lv, rv, threshold, scores=False):
            add(totals[0], rows, rn[cols])
            if not same:
                add(totals[1], cols, ln[rows])
        found = [(li, totals[0])] if same else [(li, totals[0]), (ri, totals[1])]
        ids, links, size = (np.concatenate(x) for x in zip(*[(i, t[0], t[1]) for i, t in found]))
        return pa.table({"window_id": np.full(len(ids), window, np.int64), "id": ids, "links": links, "size": size}).filter(pa.array(links > 0))
    return run


#: Pivots of a window at most, and bytes of all pivots that are broadcast; windows beyond keep blocks by hash.
PIVOTS, PIVOT_BYTES = 512, 64 << 20
#: Slack of the angles against rounding.
SLACK = 1e-6


def _assign(shared):
    """Cell (number of the nearest pivot of the window, -1 without pivots), angle to its pivot, and length of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows = b.column("window_id").to_numpy(zero_copy_only=False)
            cell, angle = np.full(len(windows), -1, np.int32), np.full(len(windows), np.pi)
            vec = b.column("vec")
            norm = np.zeros(len(windows))
            for w in np.unique(windows):
                at = np.flatnonzero(windows == w)
                x = matrix(vec.take(pa.array(at)))
                norm[at] = np.linalg.norm(x, axis=1)
                pivots = shared.value.get(int(w))
                if pivots is not None:
                    cos = (x @ pivots.T) / np.maximum(norm[at], 1e-300)[:, None]
                    cell[at] = cos.argmax(axis=1)
                    angle[at] = np.where(norm[at] > 0, np.arccos(np.clip(cos.max(axis=1), -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("window_id", "id", "vec", "n")), pa.array(cell), pa.array(angle), pa.array(norm)],
                                             names=["window_id", "id", "vec", "n", "cell", "angle", "norm"])
    return run


def _apart(vectors: np.ndarray, k: int) -> np.ndarray:
    """``k`` of the unit vectors, each as far as can be from those before it."""
    chosen, nearest = [0], vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _pivots(rows: DataFrame, sizes: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots of each window that has more than one block; none if they are too many bytes.

    Four times as many rows as there will be pivots are drawn by a hash of the
    id, and those far apart are taken, so that most clusters have one.
    """
    wanted = sizes.where("nb > 1").withColumn("k", F.least("nb", F.lit(PIVOTS)))
    total = wanted.agg(F.sum("k").alias("k"), F.max("bytes").alias("bytes")).first()
    if not total["k"] or 4 * total["k"] * total["bytes"] > PIVOT_BYTES:
        return {}
    chosen = (rows.drop("n").join(F.broadcast(wanted), "window_id").where(F.pmod(F.xxhash64("id", F.lit(11)), F.col("n")) < 4 * F.col("k"))
              .select("window_id", "id", "vec", "k").orderBy("window_id", "id").collect())  # PIVOT_BYTES at most
    out: dict[int, list[np.ndarray]] = {}
    number = {int(r["window_id"]): r["k"] for r in chosen}
    for r in chosen:
        v = np.asarray(r["vec"], np.float64)
        if np.linalg.norm(v) > 0:
            out.setdefault(int(r["window_id"]), []).append(v / np.linalg.norm(v))
    return {w: _apart(np.stack(v), number[w]) for w, v in out.items()}


def block_pairs(cells: DataFrame, pivots: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``window_id, b_lo, b_hi``: pairs of blocks that may hold a pair at the threshold.

    ``cells`` is ``window_id, cell, k, radius, norm`` (a row per cell, ``k``
    blocks each); block numbers are ``(cell + 1) << 24 | number``.
    """
    spark = cells.sparkSession
    flat = [(w, i, p.tolist()) for w, ps in pivots.items() for i, p in enumerate(ps)]
    pivot = spark.createDataFrame(flat, "window_id long, cell int, pivot array<double>")
    c = cells.join(F.broadcast(pivot), ["window_id", "cell"], "left")
    c = cut_lineage(c.select("window_id", "cell", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("number"), "radius", "norm", "pivot"))
    c = c.select("window_id", (F.shiftleft((F.col("cell") + 1).cast("long"), 24) + F.col("number")).alias("blk"), "radius", "norm", "pivot")
    x, y = c.repartition("window_id", "blk").alias("x"), c.alias("y")
    if c.count() <= BROADCAST_BLOCKS:  # a block is some thousand vectors
        y = F.broadcast(y)
    between = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("x.pivot", "y.pivot"))))
    least = F.greatest(F.lit(0.0), between - F.col("x.radius") - F.col("y.radius") - SLACK)
    can = F.col("x.norm") * F.col("y.norm") * F.cos(least) >= threshold - SLACK
    met = x.join(y, (F.col("x.window_id") == F.col("y.window_id")) & (F.col("x.blk") <= F.col("y.blk")))
    if threshold > 0:
        met = met.where(F.coalesce(can, F.lit(True)))  # a cell without a pivot meets all
    return met.select("x.window_id", F.col("x.blk").alias("b_lo"), F.col("y.blk").alias("b_hi"))


#: Blocks whose table (pivot and three numbers each) is broadcast to find the pairs.
BROADCAST_BLOCKS = 50_000


#: Blocks that a window is cut into while they are at most so many rows or, beyond, so many bytes of vectors (in double).
BLOCK_ROWS, BLOCKS, BLOCK_BYTES = 2048, 24, 32 << 20


def _met_blocks(df: DataFrame, threshold: float, id_col: str, vec_col: str, window_col: str | None, block_rows: int | None,
                stats: dict | None) -> DataFrame:
    """``window_id, id, vec, n, blk, b_lo, b_hi``: each row once per pair of blocks that it is part of.

    Without ``block_rows`` a window has at most some ``BLOCKS`` blocks until
    they reach ``BLOCK_BYTES``, so rows are repeated a bounded number of times.
    """
    win = F.col(window_col).cast("long") if window_col else F.lit(0).cast("long")
    rows = df.select(win.alias("window_id"), F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                     (F.col("n") if "n" in df.columns else F.lit(1)).cast("long").alias("n")).where("vec is not null")
    # one row per window: its block count.  Bounded by the number of windows.
    sizes = rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), (F.max(F.size("vec")) * 8).alias("bytes"))
    if block_rows:
        nb = F.ceil(F.col("n") / F.lit(block_rows))
    else:
        nb = F.least(F.ceil(F.col("n") / BLOCK_ROWS), F.greatest(F.lit(BLOCKS), F.ceil(F.col("n") * F.col("bytes") / BLOCK_BYTES)))
    sizes = cut_lineage(sizes.withColumn("nb", nb.cast("int")))
    if sizes.where("nb > 1").isEmpty():  # each window is one block
        return rows.select("*", F.lit(0).alias("blk"), F.lit(0).alias("b_lo"), F.lit(0).alias("b_hi"))
    pivots = _pivots(rows, sizes)
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most
    schema = T.StructType(list(rows.schema.fields)).add("cell", T.IntegerType()).add("angle", T.DoubleType()).add("norm", T.DoubleType())
    placed = cut_lineage(rows.mapInArrow(_assign(shared), schema))
    share = F.lit(block_rows) if block_rows else F.ceil(F.col("all") / F.col("nb"))
    cells = (placed.groupBy("window_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"), F.max("norm").alias("norm"))
             .join(F.broadcast(sizes.select("window_id", F.col("n").alias("all"), "nb")), "window_id"))
    cells = cut_lineage(cells.withColumn("k", F.ceil(F.col("n") / share).cast("int")).drop("all", "nb"))  # a row per pivot, or per window
    pairs = cut_lineage(block_pairs(cells, pivots, threshold))
    if stats is not None:
        blocks = {r["window_id"]: r["k"] for r in cells.groupBy("window_id").agg(F.sum("k").alias("k")).collect()}
        stats.update(made=pairs.count(), all=sum(k * (k + 1) // 2 for k in blocks.values()), blocks=blocks)
    blk = (F.shiftleft((F.col("cell") + 1).cast("long"), 24) + F.pmod(F.xxhash64("id"), F.col("k"))).alias("blk")
    own = placed.join(F.broadcast(cells.select("window_id", "cell", "k")), ["window_id", "cell"]).select("window_id", "id", "vec", "n", blk)
    # each block once per pair that it is part of
    of = pairs.select("window_id", F.explode(F.array_distinct(F.array("b_lo", "b_hi"))).alias("blk"), "b_lo", "b_hi")
    return own.join(F.broadcast(of) if of.count() <= BROADCAST_BLOCKS else of, ["window_id", "blk"])


def similarity_edges(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vector",
                     window_col: str | None = "window_id", block_rows: int | None = None,
                     include_self: bool = True, stats: dict | None = None) -> DataFrame:
    """All pairs (both directions, plus self) inside each window with cosine >= threshold.

    Vectors are expected to be unit length (cosine = dot product), as the
    encoder output is; null vectors have no pair.  ``id_col`` must be unique
    within a window.  ``stats`` (optional dict) receives the block pairs that
    are made and that there are.
    """
    tagged = _met_blocks(df, threshold, id_col, vec_col, window_col, block_rows, stats)
    return tagged.groupBy("window_id", "b_lo", "b_hi").applyInArrow(_block_pair_edges(float(threshold), include_self), EDGE_SCHEMA)


def neighbour_counts(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vector",
                     window_col: str | None = "window_id", block_rows: int | None = None) -> DataFrame:
    """``window_id, id, links, size`` of the same join without its edges: neighbours of each row, and their sum of ``n`` (a column, else 1)."""
    tagged = _met_blocks(df, threshold, id_col, vec_col, window_col, block_rows, None)
    parts = tagged.groupBy("window_id", "b_lo", "b_hi").applyInArrow(_block_pair_counts(float(threshold)), "window_id bigint, id bigint, links bigint, size bigint")
    return parts.groupBy("window_id", "id").agg(F.sum("links").alias("links"), F.sum("size").alias("size"))


def by_window(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """window -> (ids, vectors) of a bounded table ``window_id, id, vector``."""
    windows, ids, vectors = rows.column("window_id").to_numpy(), rows.column("id").to_numpy(), matrix(rows.column("vector"))
    return {int(w): (ids[windows == w], vectors[windows == w]) for w in np.unique(windows)}


def edges_from(some: pa.Table, rows: DataFrame, threshold: float) -> DataFrame:
    """``window_id, src, dst, score, n`` from ``some`` rows (a bounded table, broadcast) to ``rows`` (``window_id, id, vector, n``)."""
    shared = rows.sparkSession.sparkContext.broadcast(by_window(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows, ids, n = (b.column(c).to_numpy() for c in ("window_id", "id", "n"))
            vectors = matrix(b.column("vector"))
            for w in np.unique(windows):
                if w in shared.value:
                    at = np.flatnonzero(windows == w)
                    src, left = shared.value[int(w)]
                    for i, j, score in hits(left, vectors[at], threshold):
                        yield pa.RecordBatch.from_pydict({"window_id": np.full(len(i), w), "src": src[i], "dst": ids[at][j], "score": score, "n": n[at][j]})

    return rows.select("window_id", "id", "vector", "n").mapInArrow(run, "window_id bigint, src bigint, dst bigint, score double, n bigint")


def near_any(rows: DataFrame, some: pa.Table, threshold: float, near: bool) -> DataFrame:
    """Those ``rows`` (with ``window_id, vector``) that have (or do not have) one of ``some`` at the threshold."""
    shared = rows.sparkSession.sparkContext.broadcast(by_window(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            windows, vectors = b.column("window_id").to_numpy(), matrix(b.column("vector"))
            found = np.zeros(len(windows), bool)
            for w in np.unique(windows):
                right = shared.value.get(int(w), (None, np.empty((0, 0))))[1]
                for k in range(0, len(right), _TILE[1]):  # rows with a neighbour are not compared any more
                    at = np.flatnonzero((windows == w) & ~found)
                    for i, _, _ in hits(vectors[at], right[k:k + _TILE[1]], threshold, scores=False):
                        found[at[i]] = True
            yield b.filter(pa.array(found == near))

    return rows.mapInArrow(run, rows.schema)


def lsh_edges(df: DataFrame, threshold: float, id_col: str = "id", vec_col: str = "vector",
              window_col: str | None = "window_id", bucket_length: float = 0.5,
              num_hash_tables: int = 4, seed: int = 7) -> DataFrame:
    """Approximate variant: random-projection LSH candidates, then the exact check.

    For unit vectors cos >= t  <=>  euclidean distance <= sqrt(2 - 2t).  Pairs
    LSH does not propose are missed (that is the trade), every emitted pair is
    exact.  Same output schema as :func:`similarity_edges`.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    win = F.col(window_col).cast("long") if window_col else F.lit(0).cast("long")
    rows = df.select(win.alias("window_id"), F.col(id_col).cast("long").alias("id"),
                     F.col(vec_col).alias("vec"), array_to_vector(F.col(vec_col)).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                        bucketLength=bucket_length, numHashTables=num_hash_tables,
                                        seed=seed).fit(rows)
    radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-9
    pairs = model.approxSimilarityJoin(rows, rows, radius, distCol="dist")
    a, b = F.col("datasetA"), F.col("datasetB")
    scored = pairs.where(a["window_id"] == b["window_id"]).select(
        a["window_id"].alias("window_id"), a["id"].alias("src"), b["id"].alias("dst"),
        dot(a["vec"], b["vec"]).alias("score"))
    return scored.where(F.col("score") >= threshold).dropDuplicates(["window_id", "src", "dst"])
