"""Streaming ingest: three drops, a replayed file, a malformed line, restart from checkpoint."""

import json
import os
import tempfile

from corpusflow.streaming import ingest


def _drop(folder, name, rows, extra=""):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
        f.write(extra)


def test_drops_replay_restart(spark):
    base = tempfile.mkdtemp(prefix="cf-stream-", dir="/tmp")
    src, store, ckpt, arch = (os.path.join(base, x) for x in ("src", "store", "ckpt", "archive"))
    art = lambda t, d="02-03-2021": {"title": "t", "text": t, "publish_date": d}
    _drop(src, "a.jsonl", [art("one"), art("two"), art("one")], "{broken\n")
    ingest.run_ingest(spark, src, store, ckpt, archive_dir=arch)
    _drop(src, "b.jsonl", [art("two"), art("three", "2021-02-03"), art(None), art(None)])
    ingest.run_ingest(spark, src, store, ckpt, archive_dir=arch)
    # the same content again under a new name: nothing new is stored
    _drop(src, "c.jsonl", [art("one"), art("three")])
    ingest.run_ingest(spark, src, store, ckpt, archive_dir=arch)
    # restart with no new files: no change
    ingest.run_ingest(spark, src, store, ckpt, archive_dir=arch)
    rows = ingest.read_store(spark, store).collect()
    texts = sorted((r["text"] is None, r["text"] or "") for r in rows)
    assert texts == [(False, "one"), (False, "three"), (False, "two"), (True, "")]
    dates = {r["text"]: (r["publish_date"], r["publish_date_raw"]) for r in rows}
    assert str(dates["one"][0]) == "2021-02-03" and dates["three"] == (None, "2021-02-03")
    assert spark.read.parquet(store + "_rejects").count() == 1
    # files of earlier micro-batches were moved to the archive folder (Spark archives a file once a
    # later batch commits, so the newest file waits for the next drop)
    left = [f for f in os.listdir(src) if f.endswith(".jsonl")]
    assert "a.jsonl" not in left and "b.jsonl" not in left


def test_replayed_batch_writes_its_rejects_once(spark):
    from corpusflow.sources.files import read_jsonl

    base = tempfile.mkdtemp(prefix="cf-replay-", dir="/tmp")
    src, store = os.path.join(base, "src"), os.path.join(base, "store")
    _drop(src, "a.jsonl", [{"title": "t", "text": "one", "publish_date": "02-03-2021"}], "{broken\n")
    run = ingest.store_batch(store)
    for batch_id in (0, 0, 1):
        run(read_jsonl(spark, src).drop("source_row"), batch_id)
    assert spark.read.parquet(store + "_rejects").groupBy("batch_id").count().where("count > 1").count() == 0
    assert ingest.read_store(spark, store).count() == 1
