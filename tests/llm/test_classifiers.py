import os
import zlib

import numpy as np
import pytest
from helpers import clashing, documents, odd_texts, prose
from pyspark.sql import functions as F

from corpusflow.llm import quality_fm, toxicity
from corpusflow.llm.training import labelled_sample

SF = "/root/testdata/sf0.1"
CASES = [(toxicity, "toxic", 5, 0), (quality_fm, "quality", 4, 2)]


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module,label,mod,rem", CASES)
def test_odd_rows(spark, module, label, mod, rem):
    docs = odd_texts() + [(100 + k, prose(k, 60) + (" vilevile" if k % 2 else "")) for k in range(80)]
    labels = [(100 + k, k % 2, k % 2) for k in range(80)] + [(3, 1, 1), (None, 1, 0), (4, None, None), (100, 7, 7), (999, 1, 1)]
    got = module.score_documents(clashing(documents(spark, docs)), labels_table(spark, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.7))
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % mod == rem)
    assert len({r.score for r in got if r.doc_id == 7}) == 1


@pytest.mark.parametrize("module,label,mod,rem", CASES)
def test_no_labels_and_empty(spark, module, label, mod, rem):
    docs = documents(spark, odd_texts())
    none = labels_table(spark, [])
    assert {r.score for r in module.score_documents(docs, none).collect()} == {0.5}
    assert module.score_documents(docs.limit(0), none).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    """Labels of held-out rows may be anything: scores stay the same."""
    docs = documents(spark, [(k, prose(k, 40) + (" vilevile" if k % 3 == 0 else "")) for k in range(120)])
    honest = [(k, 1, int(k % 3 == 0)) for k in range(120)]
    twisted = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in honest]
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, labels_table(spark, x)).collect()} for x in (honest, twisted))
    assert a == pytest.approx(b)


def sample(spark, docs, labels, **bounds):
    return labelled_sample(clashing(documents(spark, docs)), labels_table(spark, [(i, c, c) for i, c in labels]), id_col="doc_id",
                           text_col="text", label_col="toxic", exclude=F.lit(False), **bounds)


def test_texts_over_the_bytes_are_passed_over_alone(spark):
    labels = [(k, k % 2) for k in range(40)]
    order = [i for i, _ in sample(spark, [(k, str(k)) for k, _ in labels], labels, max_rows=100, max_bytes=1000)]
    assert len(order) == 40
    docs = [(k, "x" * 2000 if str(k) in (order[0], order[7]) else "é" * 100 + str(k)) for k, _ in labels] + [(int(order[3]), "é" * 100 + order[3])] * 2
    got = sample(spark, docs, labels, max_rows=100, max_bytes=1900)
    assert got == [("é" * 100 + i, int(i) % 2) for i in [order[1], order[2], *[order[3]] * 3, *order[4:7], order[8]]]
    assert len(sample(spark, docs, labels, max_rows=7, max_bytes=1900)) == 6


def test_a_class_of_over_long_texts_is_an_error(spark):
    docs = [(k, "x" * 2000 if k % 2 else "y") for k in range(20)]
    with pytest.raises(ValueError, match="label"):
        sample(spark, docs, [(k, k % 2) for k in range(20)], max_rows=100, max_bytes=1000)
    assert len(sample(spark, docs, [(k, 0) for k in range(20)], max_rows=100, max_bytes=1000)) == 10
    assert sample(spark, [], [(k, k % 2) for k in range(20)], max_rows=100, max_bytes=1000) == []


def test_one_long_text_does_not_make_the_scores_constant(spark):
    """The text of the first id by hash is over the bytes: the other rows still train."""
    docs, labels = [(k, prose(k, 60) + (" good words" if k % 2 else " #### !!!!")) for k in range(80)], [(k, k % 2, 0) for k in range(80)]
    first = labels_table(spark, labels).where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").orderBy(F.xxhash64(F.col("doc_id").cast("string"))).first().doc_id
    docs = [(k, t * 200 if k == first else t) for k, t in docs]
    m = quality_fm.train(documents(spark, docs), labels_table(spark, labels), max_bytes=40_000)
    assert m.v.any()


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    n = quality_fm.N_FEATURES
    m = quality_fm.Model(0.3, rng.normal(size=n), rng.normal(size=(n, quality_fm.RANK)), None, None, None)
    index, value = rng.choice(n, 30, replace=False), rng.normal(size=30)
    pairs = sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(30) for b in range(a))
    assert quality_fm.raw(m, index, value) == pytest.approx(0.3 + m.w[index] @ value + pairs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data missing")
@pytest.mark.parametrize("module,label,mod,rem,least", [(toxicity, "toxic", 5, 0, 0.96), (quality_fm, "quality", 4, 2, 0.97)])
def test_held_out_accuracy(spark, module, label, mod, rem, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    r = (module.score_documents(docs, labels).where("held_out").join(labels, "doc_id")
         .selectExpr(f"avg(cast(predicted = {label} as double)) a", "count(1) n").first())
    assert r.n > 500 and r.a >= least


def test_keep_good_keeps_columns(spark):
    docs = clashing(documents(spark, odd_texts()))
    kept = quality_fm.keep_good(docs, labels_table(spark, []), cut=0.4)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    # no labels, or labels of one class: nothing to judge by, whatever the cut
    assert quality_fm.keep_good(docs, labels_table(spark, []), cut=0.6).count() == docs.count()
    assert quality_fm.keep_good(docs, labels_table(spark, [(k, 0, 0) for k in range(20)]), cut=0.6).count() == docs.count()


def test_a_rare_class_is_in_the_sample(spark):
    """Two positives among many thousand training rows, and a sample of fifty."""
    n = 20_000
    docs = [(k, f"text {k} vile" if k in (7, 11_111) else f"text {k}") for k in range(n)]
    rows = sample(spark, docs, [(k, int(k in (7, 11_111))) for k in range(n)], max_rows=50, max_bytes=10**6)
    assert sorted(t for t, c in rows if c) == ["text 11111 vile", "text 7 vile"] and len(rows) == 50
    long = [(k, "z" * 900 if k == 7 else "y" * 100) for k in range(100)]  # the rare text only fits in place of others
    rows = sample(spark, long, [(k, int(k == 7)) for k in range(100)], max_rows=20, max_bytes=1000)
    assert [c for _, c in rows].count(1) == 1 and sum(len(t) for t, _ in rows) <= 1000


def test_shares():
    from corpusflow.llm.training import shares

    assert shares({0: 30, 1: 20}, 100) == {0: 30, 1: 20}
    assert shares({0: 99_999, 1: 1}, 5000) == {0: 4999, 1: 1}
    assert shares({0: 90_000, 1: 1000}, 5000) == {0: 4500, 1: 500}
    assert shares({0: 600, 1: 400}, 100) == {0: 60, 1: 40}


def test_toxicity_equals_plain_python():
    """Features, ratios and scores made anew: sets of n-grams, a bucket for each, one text at a time."""
    def bucket(gram):
        m = (1 << 32) - 1
        h = ord(gram[0]) * 0x9E3779B1 & m
        for ch in gram[1:]:
            h = ((h ^ h >> 15) * 0x85EBCA6B + ord(ch) * 0x9E3779B1) & m
        return ((h ^ h >> 13) * 0xC2B2AE35 & m) >> 32 - 12

    def features(text):
        t = f" {text.lower()} "
        return {bucket(t[k:k + n]) for n in (2, 3) for k in range(len(t) - n + 1)}

    rows = [(prose(k, 12, 60) + (" vile words" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(60)]
    model = toxicity.fit(rows, sizes=(2, 3), bits=12, least=2, sure=2.0, steps=40)
    pos, neg = sum(c for _, c in rows), sum(1 - c for _, c in rows)
    count = [{}, {}]
    for t, c in rows:
        for f in features(t):
            count[c][f] = count[c].get(f, 0) + 1
    ratio = {}
    for f in {*count[0], *count[1]}:
        p, q = count[1].get(f, 0), count[0].get(f, 0)
        r = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (neg + 2))
        if p + q >= 2 and abs(r) >= 2.0 * np.sqrt(1 / (p + 1) + 1 / (q + 1)):
            ratio[f] = r
    assert ratio and set(np.flatnonzero(model.weights).tolist()) <= set(ratio)
    # the same regression, one text and one feature at a time
    w, b = dict.fromkeys(ratio, 0.0), float(np.log((pos + 0.5) / (len(rows) + 1) / (1 - (pos + 0.5) / (len(rows) + 1))))
    sets = [[f for f in features(t) if f in ratio] for t, _ in rows]
    m, v = dict.fromkeys([*ratio, "b"], 0.0), dict.fromkeys([*ratio, "b"], 0.0)
    for step in range(1, 41):
        g = dict.fromkeys([*ratio, "b"], 0.0)
        for own, (_, c) in zip(sets, rows):
            e = 1 / (1 + np.exp(-(b + sum(w[f] * ratio[f] for f in own)))) - c
            g["b"] += e
            for f in own:
                g[f] += e * ratio[f]
        for f in g:
            d = (g[f] + (0.3 * w[f] if f != "b" else 0.0)) / len(rows)
            m[f], v[f] = 0.9 * m[f] + 0.1 * d, 0.99 * v[f] + 0.01 * d * d
            move = 0.05 * (m[f] / (1 - 0.9 ** step)) / (np.sqrt(v[f] / (1 - 0.99 ** step)) + 1e-8)
            if f == "b":
                b -= move
            else:
                w[f] -= move
    score = toxicity.scorer(model)
    for t in [t for t, _ in rows] + ["", "vile", "Something else"]:
        z = b + sum(w[f] * ratio[f] for f in features(t) if f in ratio)
        assert score(t)[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-4)


def test_quality_scores_equal_plain_python():
    """Word features, statistics and all pairs of features made anew for each text."""
    rows = [(prose(k, 30 + k) + ("" if k % 2 else " #### !!!!\n\nbuy buy buy"), k % 2) for k in range(40)]
    m = quality_fm.fit(rows, epochs=2)

    def plain(text):
        words = text.lower().split()
        lines = [x for x in text.split("\n") if x.strip()]
        n, chars, kinds = max(1, len(words)), max(1, len(text)), sorted(set(words), key=words.index)
        number = lambda f: sum(1 for c in text if f(c))
        symbols = number(lambda c: c in "#*$%&|<>")
        stats = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(words) / max(1, len(lines)),
                 (chars - number(lambda c: c == " ")) / n, len(kinds) / n, max((words.count(w) for w in kinds), default=0) / n,
                 sum(a == b for a, b in zip(words, words[1:])) / n, symbols / n, symbols / chars, number(lambda c: c in "!?") / n,
                 number(lambda c: "A" <= c <= "Z") / chars, number(lambda c: "0" <= c <= "9") / chars, number(lambda c: c in ".,;") / n,
                 1 - len(set(lines)) / max(1, len(lines)), sum(words.count(w) for w in kinds if words.count(w) > 1) and
                 (len(words) - sum(words.count(w) == 1 for w in kinds)) / n]
        x = {}
        for w in kinds:
            f = zlib.crc32(w.encode()) % (1 << quality_fm.WORD_BITS)
            x.setdefault(f, []).append(1 / np.sqrt(max(1, len(kinds))))
        base = 1 << quality_fm.WORD_BITS
        for k, s in enumerate(stats):
            x[base + k] = [0.25 * min(4, max(-4, (s - m.mean[k]) / m.scale[k]))]
            x[base + len(stats) + k * quality_fm.BINS + sum(s > e for e in m.edges[k])] = [0.5]
        flat = [(f, value) for f, values in x.items() for value in values]
        z = m.bias + sum(m.w[f] * value for f, value in flat)
        return z + sum(float(m.v[f] @ m.v[g]) * a * b for i, (f, a) in enumerate(flat) for g, b in flat[:i])

    make = quality_fm.Features(m.mean, m.scale, m.edges)
    for text in [t for t, _ in rows[:6]] + ["", "One, two. Two!", "A1 b2\nA1 b2\n###"]:
        assert quality_fm.raw(m, *make(text)) == pytest.approx(plain(text), abs=1e-6)
