from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from corpusflow.llm import whitening as W

SCHEMA = "id bigint, vector array<float>"


def run(spark, rows, **kw):
    return W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)


def usable(rows):
    return [(i, [int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]


def sample(seed, n, dims):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    return [(i, (rng.normal(size=dims) @ mix).astype(np.float32).tolist()) for i in range(n)]


def test_factor_and_rotation():
    rng = np.random.default_rng(3)
    for dims, rank in ((1, 1), (5, 5), (12, 7), (33, 33), (64, 40)):
        b = rng.normal(size=(dims, rank)) * 10.0 ** rng.integers(-2, 3, rank)
        a = b @ b.T
        factor = W.pivoted_cholesky(a)
        assert factor.shape[1] >= rank and np.abs(factor @ factor.T - a).max() <= 1e-11 * np.abs(a).max()
        values, vectors = W.eigen(a)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
        want = np.sort(np.linalg.eigvalsh(a))[::-1]
        assert np.abs(values[:rank] - want[:rank]).max() <= 1e-12 * want[0]
    pairs = [tuple(sorted(p)) for r in W.rounds_of_pairs(7) for p in r.T.tolist()]
    assert len(pairs) == len(set(pairs)) == 21


def test_pivoted_factor_is_triangular_by_pivots():
    a = np.cov(np.random.default_rng(4).normal(size=(6, 50)))
    factor = W.pivoted_cholesky(a)
    order = [int(np.flatnonzero((factor[:, k] != 0) & (factor[:, k + 1:] == 0).all(axis=1) & (factor[:, :k] != 0).all(axis=1))[0]) for k in range(6)]
    assert np.allclose(np.triu(factor[order], 1), 0) and sorted(order) == list(range(6))


def test_whitening_against_numpy(spark):
    rows = sample(1, 200, 20)
    rows += [(300 + k, rows[0][1]) for k in range(150)] + [rows[3]]  # copies count once in the fit
    got = run(spark, rows).toPandas()
    use = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in use}), np.int64)
    n, total = len(fit), fit.sum(0)
    assert (got.n == n).all() and len(got) == 16 * len(rows)
    centred = (fit * n - total) / n
    cov = centred.T @ centred / n
    want = np.sort(np.linalg.eigvalsh(cov))[::-1]
    share = got.groupby("component").explained.first()
    assert np.allclose(share, want[:16] / np.trace(cov), rtol=1e-10)
    assert (got.identity_error < 1e-9).all() and got.identity_error.nunique() == 1
    exact = {i: sum((n * v - int(s)) ** 2 for v, s in zip(x, total)) for i, x in use}
    assert all(exact[i] == d for i, d in zip(got.id, got.deviation))
    # whitened rows of the fit list, back through the covariance
    table = got.drop_duplicates(["id", "component"]).pivot(index="id", columns="component", values="whitened")
    values, vectors = np.linalg.eigh(cov)
    for k in range(1, 17):
        e, u = values[-k], vectors[:, -k]
        x = np.array([(np.array(v) * n - total) / n for v in (dict(use)[i] for i in table.index)])
        mine, other = table[k].to_numpy(), x @ u / np.sqrt(e)
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8


def test_odd_rows(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).collect() == []  # one distinct vector: no variance
    rows = [(1, [1.0, 2.0]), (None, [3.0, 2.0]), (None, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("-inf"), 0.0]), (1, [1.0, 2.0])]
    got = sorted(run(spark, rows).collect(), key=repr)
    assert len(got) == 3 and {r.component for r in got} == {1} and {r.n for r in got} == {2}  # the second dimension is constant
    assert sorted(abs(r.whitened) for r in got) == [1.0, 1.0, 1.0] and got[0].explained == 1.0
    assert {r.deviation for r in got} == {128 ** 2}
    assert run(spark, [(1, []), (2, [])]).collect() == []
    assert len(run(spark, [(1, []), (2, [1.0, 2.0]), (3, [2.0, 2.0])]).collect()) == 6  # shorter ones are filled up


def test_exact_sums_of_wide_numbers(spark):
    rows = [(k, [1e9 * (k % 7), float(k)]) for k in range(50)]
    got = run(spark, rows).toPandas()
    use = usable(rows)
    fit = sorted({tuple(x) for _, x in use})
    n = len(fit)
    total = [sum(c) for c in zip(*fit)]
    exact = {i: sum((n * v - s) ** 2 for v, s in zip(x, total)) for i, x in use}
    assert got.deviation.isna().tolist() == [exact[i] >= 1 << 63 for i in got.id] and got.deviation.isna().any()
    cov = [[Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit), n ** 3) for j in range(2)] for i in range(2)]
    trace, det = float(cov[0][0] + cov[1][1]), cov[0][0] * cov[1][1] - cov[0][1] ** 2
    first = got[got.component == 1].explained.iloc[0]
    assert abs(first - 1) < 1e-9 and det >= 0 and trace > 0


def test_extra_columns(spark):
    df = spark.createDataFrame(sample(2, 30, 4), SCHEMA)
    wide = df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("x", "n", "ID", "component", "at", "value"))])
    assert sorted(map(tuple, W.whiten(wide).collect())) == sorted(map(tuple, W.whiten(df).collect()))
