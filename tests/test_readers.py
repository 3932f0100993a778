"""File readers for lookup tables, and the approximate LSH similarity join."""

import json
import os
import tempfile

import numpy as np

from corpusflow.operators import mixture, similarity
from corpusflow.operators import url_gate as G


def _tmp(name, text):
    folder = tempfile.mkdtemp(prefix="cf-read-", dir="/tmp")
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_allow_list_file(spark):
    path = _tmp("allow.json", json.dumps({"a.com": True, "b.com": ["www", "news"], "c.com": []}))
    rows = {r["domain"]: (r["all_subdomains"], r["subdomains"]) for r in G.read_allow_list(spark, path).collect()}
    assert rows == {"a.com": (True, None), "b.com": (False, ["www", "news"]), "c.com": (False, [])}


def test_public_suffix_file(spark):
    path = _tmp("psl.dat", "// comment\ncom\n\n*.ck\n!www.ck\nco.uk\n")
    rules = sorted(tuple(r) for r in G.read_public_suffix_list(spark, path).collect())
    assert rules == [("ck", "wildcard"), ("co.uk", "plain"), ("com", "plain"), ("www.ck", "exception")]
    hosts = spark.createDataFrame([("x.y.ck",), ("a.co.uk",)], "host string")
    parts = {r["host"]: r["suffix"] for r in G.split_hosts(hosts, G.read_public_suffix_list(spark, path)).collect()}
    assert parts == {"x.y.ck": "y.ck", "a.co.uk": "co.uk"}


def test_mixture_config_file(spark):
    path = _tmp("mix.json", json.dumps([{"name": "a", "weight": 3}, {"name": "b", "weight": 1}]))
    cfg = mixture.sampling_probabilities(mixture.read_mixture_config(spark, path))
    assert {r["name"]: r["probability"] for r in cfg.collect()} == {"a": 0.75, "b": 0.25}


def test_lsh_edges_are_exact_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 16))
    v = np.concatenate([base + 0.05 * rng.normal(size=(10, 16)) for _ in range(4)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(0, i, [float(x) for x in v[i]]) for i in range(len(v))]
    df = spark.createDataFrame(rows, "window_id long, id long, vector array<float>")
    got = {(r["src"], r["dst"]) for r in similarity.lsh_edges(df, 0.9, bucket_length=1.0, num_hash_tables=8).collect()}
    exact = {(i, j) for i in range(len(v)) for j in range(len(v)) if float(v[i] @ v[j]) >= 0.9}
    assert got and got <= exact  # every emitted pair is a true pair (float32 inputs, exact re-check)
    assert len(got) >= 0.8 * len(exact)


def test_first_row_wins_over_scanned_files(spark):
    """Copies inside one file and across its splits: the row kept is the first in load order."""
    import json
    import os
    import tempfile

    from corpusflow.operators.store import unique_first
    from corpusflow.sources import files

    folder = tempfile.mkdtemp(prefix="cf-first-", dir="/tmp")
    first = {}
    for name in ("a.jsonl", "b.jsonl"):
        with open(os.path.join(folder, name), "w") as f:
            for k in range(20_000):
                text = f"text {(k * 7919) % 500}"
                f.write(json.dumps({"text": text, "title": f"{name} {k}"}) + "\n")
                first.setdefault(text, f"{name} {k}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = files.read_jsonl(spark, folder)
        assert rows.select("source_file", "source_offset").distinct().count() > 10
        kept = unique_first(rows.select("text", "title", "source_file", "source_offset", "source_row"), "text",
                            ["source_file", "source_offset", "source_row"])
        assert {r["text"]: r["title"] for r in kept.collect()} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
