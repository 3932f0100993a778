import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import hard_negatives as H

SCHEMA = "id bigint, label int, vector array<float>"


def brute(rows, scale=256, n_pos=5, n_neg=10, low=30, high=90, every=10):
    """Every pair scored in Python integers."""
    use = [(i, c, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, c, v in rows
           if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, c, v in use:
        if i % every:
            continue
        scored = [(-score(v, w), j, d) for j, d, w in use if j != i]
        for ps, p, _ in sorted(x for x in scored if x[2] == c)[:n_pos]:
            fit = [x for x in scored if x[2] != c and low * -ps <= 100 * -x[0] <= high * -ps]
            out |= {(i, p, k, j, -ps, -s) for k, (s, j, _) in enumerate(sorted(fit)[:n_neg], 1)}
    return out


def mine(spark, rows, schema=SCHEMA, **kw):
    return H.mine(spark.createDataFrame(rows, schema).repartition(3), F.col("id") % 10 == 0, **kw)


def random_rows(seed, n, dims, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    out = []
    for i in range(n):
        c = int(rng.integers(4))
        v = centres[c if rng.random() < 0.7 else int(rng.integers(4))] + spread * rng.normal(size=dims)
        out.append((i, c, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    return out


def test_planes_hold_the_integers():
    x = np.random.default_rng(1).integers(-128, 128, (50, 13))
    planes = H.pack_planes(x, 8)
    assert (H.unpack_planes(planes)[:, :13] == x).all()
    a = np.random.default_rng(2).integers(-3000, 3000, (7, 16))
    assert (H.SubsetSums(a, 8).scores(planes) == np.pad(x, ((0, 0), (0, 3))) @ a.T).all()


@pytest.mark.parametrize("dims", [3, 16, 20])
def test_equals_brute_force(spark, dims):
    rows = random_rows(dims, 300, dims)
    got = [tuple(r) for r in mine(spark, rows).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and got


def test_many_rounds_and_blocks_give_the_same(spark, monkeypatch):
    rows = random_rows(9, 300, 8)
    monkeypatch.setattr(H, "TABLE_BYTES", 1)
    monkeypatch.setattr(H, "BLOCK", 4)
    assert {tuple(r) for r in mine(spark, rows, round_bytes=2000).collect()} == brute(rows)


def test_ties_copies_and_odd_rows(spark):
    rows = random_rows(4, 120, 6)
    same = rows[0][2]
    rows += [(200 + k, k % 3, same) for k in range(100)]  # a third are copies
    rows += [(None, 1, same), (400, None, same), (410, 1, None), (420, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (430, 1, [float("nan")] * 6), (440, 2, [float("inf")] * 6), (450, 0, []), (460, 0, [0.0] * 6), (470, 3, [0.9, 0.9])]
    assert {tuple(r) for r in mine(spark, rows).collect()} == brute(rows)
    twice = {tuple(r) for r in mine(spark, rows + [rows[0]]).select("anchor_id", "positive_id", "rank").collect()}
    assert (0, rows[0][0], 1) not in twice  # a copy of the anchor's own row is not another row


def test_large_entries_and_empty_tables(spark):
    rows = [(i, i % 2, [float(i), 1000.0 - i, 5e4]) for i in range(40)]
    assert {tuple(r) for r in mine(spark, rows).collect()} == brute(rows)
    assert mine(spark, []).collect() == [] and mine(spark, [(0, 1, [1.0])]).collect() == []


def test_extra_columns(spark):
    rows = random_rows(5, 60, 4)
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(k).alias(n) for k, n in enumerate(("x", "planes", "key", "ID", "score"))])
    assert {tuple(r) for r in H.mine(df, F.col("id") % 10 == 0).collect()} == brute(rows)
