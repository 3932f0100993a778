"""The pipeline against its stages' brute-force versions on a small fixture."""

import os
import struct
import uuid
import zlib

import public_tokenizers as P
import pytest
import test_decontaminate
import test_simhash
from helpers import DOCS, clashing, documents, odd_texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import quality_fm, secrets
from corpusflow.llm.common import pick
from corpusflow.session import ensure_checkpoint_dir

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")


def test_run_equals_brute_force(spark):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    # 1: one text at a time with the same trained model
    m = quality_fm.train(docs, labels)
    make = quality_fm.Features(m.mean, m.scale, m.edges)
    rows = [(i, t) for i, t in rows if 1 / (1 + 2.718281828459045 ** -quality_fm.raw(m, *make(t or ""))) >= 0.7]
    # 2
    group = test_simhash.brute(rows)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    # 3
    hit = {d for d, _ in test_decontaminate.brute(rows, [tuple(r) for r in items.collect()])}
    assert hit
    rows = [(i, t) for i, t in rows if i not in hit]
    # 4
    machine, clean = secrets.automaton(), []
    for i, t in rows:
        for _, a, b, _own in reversed(merged(secrets.scan(t, machine))):
            t = t[:a] + "[secret]" + t[b:]
        clean.append((i, t))
    assert clean != rows
    # 5
    tokenizer, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for i, t in clean:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def merged(spans):
    out = []
    for k, a, b, own in spans:
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(b, out[-1][2]), own)
        else:
            out.append((k, a, b, own))
    return out


def test_stages_keep_columns_and_survive_empty_input(spark):
    folder = f"{ensure_checkpoint_dir(spark)}/empty-{uuid.uuid4().hex}"
    spark.createDataFrame([], DOCS).write.parquet(folder)
    docs = spark.read.parquet(folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
    assert spark.read.parquet(f"{SF}/documents.parquet").select(F.count("*")).first()[0] > 0


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, texts that are hard to scan, and columns whose names differ in case alone."""
    docs = clashing(documents(spark, odd_texts())).select("*", *[F.lit("x").alias(c) for c in ("TEXT", "N_CHARS")])
    folder = f"{ensure_checkpoint_dir(spark)}/odd-{uuid.uuid4().hex}"
    names = docs.columns
    os.makedirs(folder, exist_ok=True)
    rows = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        kept[name] = pick(out, i="doc_id", t="text", n="n_chars").collect()
    assert len(kept["secret scans"]) == rows and all(r.n == (None if r.t is None else len(r.t)) for r in kept["secret scans"])
    assert len(kept["benchmark decontamination"]) == rows
    assert len(kept["SimHash near-dedup"]) < rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == rows
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs.limit(0), SF).collect()


def test_stages_called_alone_bound_the_arrow_batches(spark):
    docs = documents(spark, [(k, f"some words of text {k}") for k in range(40)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, 10_000)
            stage(spark, docs, SF).collect()
            assert int(spark.conf.get(key)) <= 1000, name
    finally:
        spark.conf.set(key, before)


def test_packing_keeps_few_words_in_a_worker(spark):
    def largest(batches):
        from corpusflow.llm.common import _KEPT

        sizes = [x.parts.size for x in _KEPT.values() if hasattr(x, "parts")]
        for b in batches:
            yield b.from_pydict({"n": [min(sizes, default=0)]})

    docs = documents(spark, [(k, f"some words of text {k}") for k in range(40)])
    corpus_pipeline.best_fit_packing(spark, docs, SF).collect()
    kept = [r.n for r in spark.range(40).mapInArrow(largest, "n bigint").collect() if r.n]
    assert kept and min(kept) <= 50_000
