"""Bounds on what a task holds."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import article, batching, bpe, metrics


def test_python_workers_get_small_batches(spark):
    sizes = spark.range(5000, numPartitions=1).mapInArrow(
        lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= 1000


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    given = spark.range(350, numPartitions=1).select("id", F.concat(F.lit("<p>a page "), F.col("id").cast("string"), F.lit("</p>")).alias("html"))
    parsed = article.extract_articles(given, "html", ["id"])
    sizes = parsed.mapInArrow(lambda batches: (type(b).from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 350 and article.PARSED_ROWS <= 100


def test_padding_at_the_end_needs_no_look_at_each_element(spark):
    cases = [[5, 6, 0, 0], [1], [0], [0, 0], [], [0, 3, 0], [1, 0, 2, 0, 0], [1, None, 0], [2, 0, None, 0], None]

    def runs(ids):
        if ids is None:
            return None
        out = []
        for k, x in enumerate(ids):
            if x == 0:
                if out and out[-1][1] == k:
                    out[-1] = (out[-1][0], k + 1)
                else:
                    out.append((k, k + 1))
        return out

    df = spark.createDataFrame(list(enumerate(cases)), "k int, ids array<bigint>")
    got = {r["k"]: r["r"] for r in df.select("k", batching.padding_runs("ids").alias("r")).collect()}
    plain = [c for c in cases if c is not None and None not in c]
    assert [[tuple(x) for x in got[cases.index(c)]] for c in plain] == [runs(c) for c in plain]
    plan = df.select(batching.padding_runs("ids").alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan


def test_single_precision_vectors_are_not_widened_for_the_shuffle(spark):
    rng = np.random.default_rng(2)
    rows = [(0, k, *(rng.normal(size=6).astype(np.float32).tolist() for _ in range(2))) for k in range(9)]
    schema = "batch_id long, row long, anchor array<{0}>, positive array<{0}>"
    loss = {}
    for kind in ("float", "double"):
        out = metrics.in_batch_contrastive(spark.createDataFrame(rows, schema.format(kind)))
        loss[kind] = out.first()["loss"]
        plan = out._jdf.queryExecution().optimizedPlan().toJSON().replace(" ", "")
        assert ('"elementType":"double"' in plan) == (kind == "double")
    assert abs(loss["float"] - loss["double"]) < 1e-9


def test_ascii_texts_are_in_normal_form(spark):
    df = spark.createDataFrame([("plain",), ("ﬁne Ａ",), (None,)], "t string")
    assert [r[0] for r in df.select(bpe.nfkc(F.col("t"))).collect()] == ["plain", "fine A", None]
