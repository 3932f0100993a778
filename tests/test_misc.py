"""Array-form positional encoding, article sink, gz JSON scan, default encoder."""

import gzip
import json
import math
import os
import tempfile

from pyspark.sql import functions as F

from corpusflow.operators import encoder, metrics
from corpusflow.sources import files


def test_positional_forms_agree(spark):
    pos = spark.range(4).select(F.col("id").alias("pos"))
    arr = {r["pos"]: r["pe"] for r in pos.select("pos", metrics.positional_encoding("pos", 8).alias("pe")).collect()}
    for r in metrics.positional_long(pos, "pos", 8).collect():
        assert math.isclose(arr[r["pos"]][r["i"]], r["value"], abs_tol=1e-12)
    assert math.isclose(arr[1][0], math.sin(1.0)) and math.isclose(arr[1][1], math.cos(1.0))
    assert math.isclose(arr[2][2], math.sin(2.0 / 10000 ** (2 / 8)))


def test_article_sink_and_gz_scan(spark):
    folder = tempfile.mkdtemp(prefix="cf-misc-", dir="/tmp")
    df = spark.createDataFrame([("t1", "x", "2021-04", "a1"), ("t2", "y", "2021-04", "a2")],
                               "title string, text string, month string, archive string")
    files.write_articles(df, os.path.join(folder, "out"))
    assert sorted(os.listdir(os.path.join(folder, "out", "month=2021-04"))) == ["archive=a1", "archive=a2"]
    gz = os.path.join(folder, "c4-train.00000-of-00512.json.gz")
    with gzip.open(gz, "wt") as f:
        for i in range(5):
            f.write(json.dumps({"text": f"doc {i}", "url": f"u{i}"}) + "\n")
    back = files.read_gz_json(spark, [gz], files.ARTICLE_SCHEMA, partitions=2)
    assert back.count() == 5 and back.rdd.getNumPartitions() == 2


def test_default_encoder_unit_vectors(spark):
    df = spark.createDataFrame([("the cat sat",), ("the dog sat",), ("",)], "text string")
    out = encoder.encode_column(df, "text").collect()
    norms = [math.sqrt(sum(x * x for x in r["vector"])) for r in out]
    assert [round(n, 5) for n in norms[:2]] == [1.0, 1.0] and norms[2] == 0.0
    assert len(out[0]["vector"]) == encoder.NUM_FEATURES
