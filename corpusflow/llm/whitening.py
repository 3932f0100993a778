"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers.  The distinct vectors are the fit list; their rows,
centred on the integers next to the means, are multiplied into exact integer
sums, from which the remaining fraction of the means is taken out exactly: the
centred scatter has no rounding but its last.  Pivoted Cholesky factors it,
stopping where no variance is left, and one-sided Jacobi rotates the columns of
the triangular factor until they are orthogonal: their squared lengths are the
eigenvalues, the columns themselves, made unit, the components.

Spark makes the fit list, the sums and the projections; the driver sees nothing
but sums of one and two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, pick
from .vectors import finite, matrix

SWEEPS = 60
#: Share of the largest pivot that counts as nothing.
RANK_SHARE = 1e-13
_LONG = 1 << 63

RESULT = "id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def pivoted_cholesky(a: np.ndarray, share: float = RANK_SHARE) -> np.ndarray:
    """L (dims x rank) with a = L L', one column per pivot, the largest remaining diagonal entry first.

    With rows in order of their pivots L is lower triangular.  It ends where the
    largest remaining entry is at most ``share`` of the first.
    """
    left, columns = np.diag(a).astype(float), []
    least = share * max(left.max(initial=0.0), 0.0)
    for _ in range(len(a)):
        p = int(np.argmax(left))
        if not left[p] > least:
            break
        column = a[:, p].copy()
        for done in columns:
            column -= done * done[p]
        column /= np.sqrt(left[p])
        column[left == -np.inf] = 0.0  # rows of earlier pivots
        column[p] = np.sqrt(left[p])
        columns.append(column)
        left = np.where(left == -np.inf, left, left - column ** 2)
        left[p] = -np.inf
    return np.array(columns).T.reshape(len(a), len(columns))


def rounds_of_pairs(n: int) -> list[np.ndarray]:
    """All pairs of ``n`` columns in rounds of disjoint pairs, so that one round's rotations do not meet."""
    seats = list(range(n)) + ([-1] if n % 2 else [])
    half, out = len(seats) // 2, []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:half], reversed(seats[half:])) if a >= 0 and b >= 0]
        out.append(np.array(pairs, int).reshape(-1, 2).T)
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """``factor`` times a rotation, with columns that are orthogonal but for the rounding of their products."""
    w = factor.copy()
    pairs = rounds_of_pairs(w.shape[1])
    tolerance = np.finfo(float).eps * max(1.0, np.sqrt(len(w)))
    for _ in range(sweeps):
        turned = False
        for a, b in pairs:
            x, y = w[:, a], w[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(xy), where=size > 0)
            turn = off > tolerance
            if not turn.any():
                continue
            turned = True
            a, b, x, y = a[turn], b[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            w[:, a], w[:, b] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return w


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, components as columns) by falling value; as many as the rank."""
    w = one_sided_jacobi(pivoted_cholesky(covariance))
    length = np.sqrt((w * w).sum(0))
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    return length[order] ** 2, w[:, order] / length[order]


@dataclass
class Whitening:
    """What a task needs: whole part and fraction of the means, the projection, the sums."""

    n: int
    dims: int
    centre: np.ndarray  # integers
    rest: np.ndarray    # n * mean - n * centre, integers
    values: np.ndarray
    project: np.ndarray  # dims x components, components over the root of their values
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest / self.n) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)^2 of each row; None where it is no long."""
        y = x - self.centre
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, self.dims) < _LONG:
            d = y * self.n - self.rest
            return (d * d).sum(1).tolist()
        sums = [sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in y]
        return [s if s < _LONG else None for s in sums]


def integers(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)


def _added(fit: DataFrame, kind: str, part) -> list:
    """Entry-wise sum of the lists that ``part(batches)`` gives, one per task; added up in two steps of at most 64 groups.

    A task gives one row, and what is left for the driver is one row of as many
    numbers as a list has (dims * dims at most).
    """
    as_number = int if kind.startswith("decimal") else float
    arrow = pa.decimal128(38, 0) if as_number is int else pa.float64()

    def row(of: int, values: np.ndarray):
        return [pa.array([of], pa.int32()), pa.array([[as_number(v) for v in values.tolist()]], pa.list_(arrow))]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays(row(TaskContext.get().partitionId(), part(batches)), names=["of", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for values in table.column("sums").to_pylist():
            total = np.array([as_number(v) for v in values], object if as_number is int else float) + total
        return pa.table(row(table.column("of")[0].as_py(), total), names=["of", "sums"])

    schema = f"of int, sums array<{kind}>"
    sums = fit.select("x").mapInArrow(first, schema)
    for groups in (64, 1):
        sums = sums.groupBy(F.pmod("of", F.lit(groups)).alias("group")).applyInArrow(add, schema)
    return [as_number(v) for v in sums.first()["sums"]]


def _sums(fit: DataFrame, dims: int, centre: np.ndarray | None) -> tuple[int, list[int]]:
    """Row count and exact column sums, or the exact products (upper triangle, by rows) of columns centred on ``centre``."""
    upper = np.triu_indices(dims)

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, total = 0, np.zeros(dims if centre is None else len(upper[0]), object)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = matrix(b.column("x").slice(at, 4096), dims)
                n += len(x)
                if centre is None:
                    total += x.astype(object).sum(0) if np.abs(x).max(initial=0) >= 1 << 50 else x.sum(0)
                    continue
                y = x - centre
                most = int(np.abs(y).max(initial=0))
                exact = most * most * max(1, len(y)) < 1 << 53  # then products in double are exact
                y = y.astype(float if exact else object)
                product = (y.T @ y)[upper]
                total += product.astype(np.int64) if exact else product
        return np.concatenate(([n], total)).astype(object)

    n, *values = _added(fit, "decimal(38,0)", part)
    return n, values


def fit_whitening(fit: DataFrame, dims: int, components: int) -> Whitening:
    """Fit on the rows of ``fit`` (column ``x``, integers; at least one row)."""
    n, sums = _sums(fit, dims, None)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the integers next to the means
    rest = [s - n * c for s, c in zip(sums, centre)]
    _, products = _sums(fit, dims, np.array(centre, np.int64))
    covariance, trace = np.zeros((dims, dims)), 0
    for i, j, product in zip(*(k.tolist() for k in np.triu_indices(dims)), products):
        exact = n * product - rest[i] * rest[j]  # n^2 times the covariance
        covariance[i, j] = covariance[j, i] = exact / (n * n)
        trace += exact if i == j else 0
    values, vectors = eigen(covariance)
    values, vectors = values[:components], vectors[:, :components]
    return Whitening(n, dims, np.array(centre, np.int64), np.array(rest, np.int64), values, vectors / np.sqrt(values), trace / (n * n))


def identity_error(fit: DataFrame, shared) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over ``fit``."""
    k, dims = len(shared.value.values), shared.value.dims

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = shared.value.whiten(matrix(b.column("x"), dims))
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        return total.reshape(-1)

    total, n = np.array(_added(fit, "double", part)).reshape(k + 1, k), shared.value.n
    mean = total[k] / n  # the rows are centred: this is rounding alone
    return float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, *, id_col: str = "id", vector_col: str = "vector", scale: int = 64, shift: int = 1_000_000,
           components: int = 16) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component.

    An entry c becomes x = floor(``scale`` * c) + ``shift``.  The fit list is
    each distinct x vector once; n is its length.  ``whitened`` is the row less
    the mean, projected on a unit eigenvector of the fit list's covariance over
    the root of its eigenvalue; ``explained`` is the eigenvalue's share of the
    trace.  ``deviation`` is the exact sum of (n x - S)^2 (null where that is no
    long); ``identity_error`` is measured on the whitened fit list.

    Rows whose vector is null or holds a null or non-finite entry go.  A vector
    with fewer entries than the longest is filled up with zeros in place of x.
    Null ids stay; repeated rows give repeated rows.  Components without
    variance have no whitened value and give no rows, so with fewer than two
    distinct vectors, or an empty table, the result is empty.
    """
    spark = rows.sparkSession
    out = RESULT.format(id=dict(rows.dtypes)[id_col])
    given = pick(rows, id=id_col, vector=vector_col).where(finite(F.col("vector")))
    whole = given.select("id", integers(F.col("vector"), scale, shift).alias("x"))
    fit = checkpoint(whole.select("x").distinct())
    dims = fit.agg(F.max(F.size("x"))).first()[0] or 0
    model = fit_whitening(fit, dims, components) if dims else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    shared = spark.sparkContext.broadcast(model)  # dims x components numbers
    k, error = len(model.values), identity_error(fit, shared)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        share = m.values / m.trace
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                x = matrix(some.column("x"), m.dims)
                owner = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id").take(pa.array(owner)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(owner), m.n)), pa.array(m.deviation(x), pa.int64()).take(pa.array(owner)),
                     pa.array(m.whiten(x).reshape(-1)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(owner), error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, out).withColumnRenamed("id", id_col)
