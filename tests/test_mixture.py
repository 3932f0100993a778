"""Mixture (S13, S14, L7, L8) and contrastive metric (A9) properties."""

import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import metrics, mixture


def test_pair_readers(spark):
    folder = tempfile.mkdtemp(prefix="cf-mix-", dir="/tmp")
    p = os.path.join(folder, "qa.jsonl")
    with open(p, "w") as f:
        f.write(json.dumps(["q1", "a1"]) + "\n" + json.dumps({"texts": ["q2", "a2"]}) + "\n")
    df = mixture.read_pair_dataset(spark, p)
    assert sorted(r["texts"] for r in df.collect()) == [["q1", "a1"], ["q2", "a2"]]
    assert df.first()["dataset"] == "qa"
    fp = os.path.join(folder, "forum.jsonl")
    with open(fp, "w") as f:
        f.write(json.dumps({"response": "r", "context": "c"}) + "\n" + json.dumps({"response": "x"}) + "\n")
    assert [r["texts"] for r in mixture.read_forum_dataset(spark, fp).collect()] == [["r", "c"]]


def test_mixed_arity_raises(spark):
    df = spark.createDataFrame([("d", ["a", "b"]), ("d", ["a", "b", "c"])], "dataset string, texts array<string>")
    try:
        mixture.check_arity(df)
    except ValueError:
        return
    raise AssertionError("mixed arity accepted")


def test_unique_texts_per_batch_and_arity(spark):
    rows = [("pairs", [f"t{i % 7}", f"u{i}"]) for i in range(60)] + [("triples", [f"t{i}", "x", f"y{i}"]) for i in range(30)]
    rows += [("zero", ["z", "w"])]
    smp = spark.createDataFrame(rows, "dataset string, texts array<string>")
    cfg = spark.createDataFrame([("pairs", 2), ("triples", 1), ("zero", 0)], "name string, weight long")
    plan = mixture.batch_plan(cfg, mixture.check_arity(smp).select("dataset", "arity"), 12, 2, seed=3)
    p = plan.collect()
    assert all(r["dataset"] != "zero" for r in p)
    by_batch = {}
    for r in p:
        by_batch.setdefault(r["batch"], set()).add(r["arity"])
    assert all(len(a) == 1 for a in by_batch.values())
    out = mixture.unique_text_batches(smp, plan, per_slot=3, seed=3).collect()
    seen = {}
    for r in out:
        for t in r["texts"]:
            assert (r["batch"], t) not in seen
            seen[(r["batch"], t)] = 1
    # "pairs" has only 7 distinct first texts: its slots still fill (3 each) thanks to the retry;
    # every triple holds the text "x", so a batch can take one triple at most
    counts, triples = {}, {}
    for r in out:
        counts[(r["batch"], r["slot"], r["dataset"])] = counts.get((r["batch"], r["slot"], r["dataset"]), 0) + 1
        if r["dataset"] == "triples":
            triples[r["batch"]] = triples.get(r["batch"], 0) + 1
    assert {v for (b, s, d), v in counts.items() if d == "pairs"} == {3}
    assert set(triples.values()) <= {1}


def sequential(spark, rows, plan, per_slot, seed):
    """One slot after the other, one sample after the other."""
    from corpusflow.functions.hashing import seeded_hash, wide_hash

    smp = spark.createDataFrame(rows, "dataset string, texts array<string>")
    sk = F.sha2(F.array_join(F.transform("texts", lambda t: F.coalesce(F.sha2(t, 256), F.lit(""))), "|"), 256)
    hashed = [(r.dataset, r.h, r.k, r.texts) for r in smp.select("dataset", "texts", sk.alias("k"), seeded_hash(F.xxhash64(sk), seed).alias("h")).collect()]
    order = {}
    for d, h, k, t in sorted(hashed, key=lambda x: x[:3]):
        order.setdefault(d, []).append(t)
    starts = {(r.batch, r.slot): r.w for r in plan.select("batch", "slot", wide_hash(F.col("batch") * 1000 + F.col("slot"), seed + 1).alias("w")).collect()}
    out, seen = [], {}
    for r in sorted(plan.collect(), key=lambda r: (r.batch, r.slot)):
        stream, have = order.get(r.dataset, []), 0
        used = seen.setdefault(r.batch, set())
        for j in range(len(stream)):
            t = stream[(starts[r.batch, r.slot] + j) % len(stream)]
            if have < per_slot and not used & set(t):
                used |= set(t)
                have += 1
                out.append((r.batch, r.slot, j, r.dataset, tuple(t)))
        out = [(*x, have < per_slot) if len(x) == 5 else x for x in out]
    return out


def test_batches_equal_the_sequential_greedy_with_bounded_groups(spark):
    """A dataset that mostly repeats one text, one without repeats, one too small to fill a slot."""
    rows = [("same", ["t", "u"])] * 400 + [("same", [f"s{k}", f"v{k}"]) for k in range(9)]
    rows += [("wide", [f"w{k}", f"x{k % 5}"]) for k in range(300)] + [("small", ["a", "b"]), ("small", ["t", None]), ("small", ["c", "d"])]
    plan = spark.createDataFrame([(b, s, d) for b in range(6) for s, d in enumerate(("wide", "same", "small", "same")[:2 + b % 3])],
                                 "batch long, slot long, dataset string")
    stats = {}
    got = mixture.unique_text_batches(spark.createDataFrame(rows, "dataset string, texts array<string>"), plan, 4, seed=5, over_draw=2, stats=stats)
    key = lambda x: str(x)
    assert sorted([(r.batch, r.slot, r.pos, r.dataset, tuple(r.texts), r.short) for r in got.collect()], key=key) == sorted(
        sequential(spark, rows, plan, 4, 5), key=key)
    assert stats["largest"] <= 4 * (4 * 2 + 1) and 2 < stats["rounds"] < 30


def test_contrastive_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a, p, n = rng.normal(size=(5, 4)), rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    rows = [(0, i, a[i].tolist(), p[i].tolist(), n[i].tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "batch_id long, row long, anchor array<double>, positive array<double>, negative array<double>")

    def unit(v):
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def ce(s):
        m = s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s - m).sum(1)) + m[:, 0] - np.diag(s)))

    s = 20 * unit(a) @ unit(p).T
    got = metrics.in_batch_contrastive(df).first()["loss"]
    assert abs(got - (ce(s) + ce(s.T)) / 2) < 1e-9
    s3 = 20 * unit(a) @ np.concatenate([unit(p), unit(n)]).T
    got3 = metrics.in_batch_contrastive(df, negative="negative").first()["loss"]
    assert abs(got3 - ce(s3)) < 1e-9


def test_masks(spark):
    from corpusflow.operators import batching as B
    df = spark.createDataFrame([([5, 3, 0],)], "ids array<bigint>")
    r = df.select(B.padding_mask("ids").alias("p"), B.look_ahead_mask(F.lit(3)).alias("la"),
                  B.combined_mask("ids").alias("c"), *[x.alias(n) for x, n in zip(B.shift("ids"), ["i", "t"])]).first()
    assert r["p"] == [0, 0, 1]
    assert r["la"] == [[0, 1, 1], [0, 0, 1], [0, 0, 0]]
    assert r["c"] == [[0, 1, 1], [0, 0, 1], [0, 0, 1]]
    assert r["i"] == [5, 3] and r["t"] == [3, 0]


def test_mask_intervals_equal_the_matrices(spark):
    from corpusflow.operators import batching as B
    rows = [[5, 3, 0], [0, 0, 7, 0, 2, 0, 0], [1], [0], [], [4, 4, 4]]
    df = spark.createDataFrame([(r,) for r in rows], "ids array<bigint>").withColumn("m", B.mask_intervals("ids"))
    for r in df.select("ids", "m", B.masked_cells(F.col("m")).alias("cells")).collect():
        n = len(r.ids)
        whole = [[int(j > i or r.ids[j] == 0) for j in range(n)] for i in range(n)]
        assert r.cells == sum(map(sum, whole)) and r.m["size"] == n
        assert len(r.m["runs"]) <= (n + 1) // 2
    one = df.where("size(ids) = 7")
    matrix = one.select(B.combined_mask("ids")).first()[0]
    assert [one.select(B.combined_row(F.col("m"), F.lit(i))).first()[0] for i in range(7)] == matrix


def loss_of(a, p, n=None, scale=20.0):
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def ce(s):
        m = s.max(axis=1)
        return float(np.mean(np.log(np.exp(s - m[:, None]).sum(axis=1)) + m - s[np.arange(len(s)), np.arange(len(s))]))

    if n is None:
        s = scale * unit(a) @ unit(p).T
        return (ce(s) + ce(s.T)) / 2
    return ce(scale * unit(a) @ np.concatenate([unit(p), unit(n)]).T)


def test_contrastive_blocks_merge_to_the_whole_loss(spark):
    from corpusflow.operators import metrics as M
    rng = np.random.default_rng(3)
    a, p, n = (rng.normal(size=(70, 6)) for _ in range(3))
    df = spark.createDataFrame([(k // 50, k, a[k].tolist(), p[k].tolist(), n[k].tolist()) for k in range(70)],
                               "batch_id long, row long, anchor array<double>, positive array<double>, negative array<double>")
    for block in (7, 2048):
        for neg, scale in ((None, 20.0), ("negative", 20.0), (None, 900.0)):
            got = {r.batch_id: (r.rows, r.loss) for r in M.in_batch_contrastive(df, negative=neg, scale=scale, block=block).collect()}
            for b, part in ((0, slice(0, 50)), (1, slice(50, 70))):
                want = loss_of(a[part], p[part], n[part] if neg else None, scale)
                assert got[b][0] == part.stop - part.start and abs(got[b][1] - want) < 1e-9


def test_contrastive_batch_of_fifty_thousand_rows(spark):
    """One batch far larger than a task's block."""
    from corpusflow.operators import metrics as M
    rng = np.random.default_rng(4)
    a, p = (rng.normal(size=(50_000, 2)).round(3) for _ in range(2))
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"batch_id": 0, "row": range(50_000), "anchor": a.tolist(), "positive": p.tolist()}),
                               "batch_id long, row long, anchor array<double>, positive array<double>")
    got = M.in_batch_contrastive(df.repartition(8), block=8192).collect()
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    ua, up = unit(a).astype(np.float32), unit(p).astype(np.float32)  # the plain sums in single precision
    own = 20 * (ua * up).sum(axis=1)
    f = np.concatenate([np.log(np.exp(20 * ua[k:k + 2000] @ up.T - 20).sum(axis=1)) + 20 for k in range(0, 50_000, 2000)])
    b = np.concatenate([np.log(np.exp(20 * up[k:k + 2000] @ ua.T - 20).sum(axis=1)) + 20 for k in range(0, 50_000, 2000)])
    assert [r.rows for r in got] == [50_000] and abs(got[0].loss - ((f - own).mean(dtype=float) + (b - own).mean(dtype=float)) / 2) < 1e-4


def test_an_all_padding_batch_has_no_metrics(spark):
    from corpusflow.operators import metrics as M
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 0, [0.5, 0.1]), (1, 1, [0.0, 3.0])], "b long, label long, logits array<double>")
    got = {r.b: (r.loss, r.accuracy, r.tokens) for r in M.masked_token_metrics(df, ["b"]).collect()}
    assert got[0] == (None, None, 0) and got[1][1:] == (1.0, 1)
