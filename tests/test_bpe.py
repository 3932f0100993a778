"""BPE trainer / encoder equal the installed `tokenizers` package on a small corpus (test-only use)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import bpe

tokenizers = pytest.importorskip("tokenizers")

REPEATS = ["aaaa aaa aa abab ababab baba", "aaaaaa bbbb abba aabb", "zzzz zz zzz abab aaaa"] * 4 + ["aa ab ba bb"]
RECORDS = ["Hello world, hello there![start] A new day's news [end]",
           "Café été 2021 -- numbers 12345 and  spaces\tTabs[start] ok ok ok [end]",
           "The quick brown fox jumps[start] over the lazy dog's back [end]"] * 3 + \
          ["Hello again world[start] news again [end]", "ﬁne ligature ①[start] x [end]"]


def reference(vocab_size, records=None):
    records = records or RECORDS
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers
    from tokenizers.normalizers import NFKC
    folder = tempfile.mkdtemp(prefix="cf-bpe-", dir="/tmp")
    path = os.path.join(folder, "corpus.txt")
    with open(path, "w") as f:
        f.write("".join(r + "\n\n" for r in records))
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    tok.normalizer = NFKC()
    tok.train([path], trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=2,
                                          special_tokens=["<|endoftext|>", "<|padding|>"]))
    return tok, json.loads(tok.to_str())


@pytest.mark.parametrize("vocab_size", [60, 140])
def test_train_encode_decode_equal_reference(spark, vocab_size):
    tok, ref = reference(vocab_size)
    lines = spark.createDataFrame([(i, r) for i, r in enumerate(RECORDS)], "k long, value string")
    vocab, merges = bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(lines)), vocab_size=vocab_size)
    ref_vocab = sorted(ref["model"]["vocab"].items(), key=lambda kv: kv[1])
    assert [(r["token"], r["id"]) for r in vocab.orderBy("id").collect()] == [tuple(v) for v in ref_vocab]
    ref_merges = [m if isinstance(m, list) else m.split(" ") for m in ref["model"]["merges"]]
    assert [[r["left"], r["right"]] for r in merges.orderBy("rank").collect()] == ref_merges
    enc = {r["k"]: list(r["ids"]) for r in bpe.encode_texts(lines, ["k"], "value", vocab, merges).collect()}
    assert all(enc[i] == tok.encode(t).ids for i, t in enumerate(RECORDS))
    dec = {r["k"]: r["text"] for r in bpe.decode_ids(
        spark.createDataFrame([(k, v) for k, v in enc.items()], "k long, ids array<bigint>"), "ids", vocab, ["k"]).collect()}
    import unicodedata
    assert all(dec[i].lstrip(" ") == unicodedata.normalize("NFKC", t).lstrip(" ") for i, t in enumerate(RECORDS))


def test_byte_alphabet_rule():
    a = bpe.byte_alphabet()
    assert len(set(a)) == 256 and a[ord("A")] == "A" and a[ord(" ")] == "Ġ" and a[ord("\n")] == "Ċ"


@pytest.mark.parametrize("vocab_size", [40, 80])
def test_repeated_tokens_equal_reference(spark, vocab_size):
    _, ref = reference(vocab_size, REPEATS)
    lines = spark.createDataFrame([(r,) for r in REPEATS], "value string")
    vocab, merges = bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(lines)), vocab_size=vocab_size)
    ref_merges = [m if isinstance(m, list) else m.split(" ") for m in ref["model"]["merges"]]
    assert [[r["left"], r["right"]] for r in merges.orderBy("rank").collect()] == ref_merges


SELF_PAIRS = ["bbbaaaabbaba"] * 3 + ["abb"] + ["caaaaaaa"] * 5 + ["aaa"]
NEWLINES = ["first line\nsecond line here\n\nthird line", " line\n", "second third\nfirst line", "line\r\nline line"] * 3


def one_at_a_time(words, n_merges):
    """Plain BPE: count all pairs anew, merge the most frequent (ties: smaller token ids)."""
    chars = sorted({c for w in words for c in w})
    ids = {c: i for i, c in enumerate(chars)}
    seqs = [([ids[c] for c in w], n) for w, n in words.items()]
    names, out = list(chars), []
    for _ in range(n_merges):
        counts = {}
        for s, n in seqs:
            for p in zip(s, s[1:]):
                counts[p] = counts.get(p, 0) + n
        best = min(((-n, p) for p, n in counts.items() if n >= 2), default=None)
        if best is None:
            break
        a, b = best[1]
        token = names[a] + names[b]
        if token not in ids:
            ids[token] = len(names)
            names.append(token)
        out.append([names[a], names[b]])
        new = []
        for s, n in seqs:
            r, k = [], 0
            while k < len(s):
                if k + 1 < len(s) and (s[k], s[k + 1]) == (a, b):
                    r.append(ids[token])
                    k += 2
                else:
                    r.append(s[k])
                    k += 1
            new.append((r, n))
        seqs = new
    return out


@pytest.mark.parametrize("records,vocab_size", [(SELF_PAIRS, 24), (NEWLINES, 70)])
def test_self_pairs_and_newlines_equal_reference(spark, records, vocab_size):
    _, ref = reference(vocab_size, records)
    lines = spark.createDataFrame([(r,) for r in records], "value string")
    _, merges = bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(lines)), vocab_size=vocab_size)
    ref_merges = [m if isinstance(m, list) else m.split(" ") for m in ref["model"]["merges"]]
    assert [[r["left"], r["right"]] for r in merges.orderBy("rank").collect()] == ref_merges


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_one_merge_at_a_time(spark, seed):
    import random

    r = random.Random(seed)
    words = {}
    for _ in range(14):
        words["".join(r.choice("aab" if seed % 2 else "abc") for _ in range(r.randrange(1, 14)))] = r.randrange(1, 6)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = one_at_a_time(words, 12)
    n_chars = len({c for w in words for c in w})
    for top_k in (1, 256):
        _, merges = bpe.train_bpe(df, vocab_size=n_chars + len({a + b for a, b in want}), special_tokens=(), top_k=top_k)
        got = [[x["left"], x["right"]] for x in merges.orderBy("rank").collect()]
        assert got == want[:len(got)] and len(got) >= len(want) - 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_null_texts_and_empty_ids_are_kept(spark):
    lines = spark.createDataFrame([(0, "ab ab"), (1, None), (2, "")], "k long, value string")
    vocab, merges = bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(lines.where("k = 0"))), vocab_size=20)
    assert bpe.encode_texts(lines, ["k"], "value", vocab, merges).count() == 3
    ids = spark.createDataFrame([(0, []), (1, None)], "k long, ids array<bigint>")
    assert {r["k"]: r["text"] for r in bpe.decode_ids(ids, "ids", vocab, ["k"]).collect()} == {0: "", 1: ""}


def random_words(seed, n=60, letters="aab"):
    import random

    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randrange(1, 14))): r.randrange(1, 9) for _ in range(n)}


@pytest.mark.parametrize("seed", range(3))
def test_few_known_pairs_and_small_chunks_give_the_same(spark, monkeypatch, seed):
    """A head of three pairs is read again and again, chunks of seven words are rebuilt each round."""
    from corpusflow.operators import bpe_rounds

    words = random_words(seed, letters="aabc")
    want = one_at_a_time(words, 25)
    monkeypatch.setattr(bpe_rounds.merge_rounds, "__defaults__", (3,))
    stats = {}
    _, merges = bpe.train_bpe(spark.createDataFrame(list(words.items()), "word string, n long"), special_tokens=(),
                              vocab_size=3 + len({a + b for a, b in want}), words_per_partition=7, stats=stats)
    got = [[x["left"], x["right"]] for x in merges.orderBy("rank").collect()]
    assert got == want[:len(got)] and len(got) >= len(want) - 1 and stats["reads"] > 1


def test_a_round_touches_only_the_words_with_a_merged_pair(spark):
    """Pair counts are read in full once; each round reads the postings of its pairs."""
    words = {f"{a}{b}" * 3: 1000 - 10 * k for k, (a, b) in enumerate(zip("acegikmoqsuwy", "bdfhjlnprtvxz"))}
    stats = {}
    _, merges = bpe.train_bpe(spark.createDataFrame(list(words.items()), "word string, n long"), special_tokens=(), vocab_size=26 + 13 * 2,
                              top_k=1, stats=stats)
    assert merges.count() == 26 and stats["reads"] == 1
    assert stats["touched"] == [1] * 26  # of thirteen words


def test_chunk_counts_after_rounds_equal_a_recount():
    import random

    import numpy as np

    from corpusflow.operators.bpe_rounds import Chunk, pair

    r = random.Random(5)
    words = [[r.randrange(4) for _ in range(r.randrange(1, 12))] for _ in range(40)]
    row = [np.array(x, t).tobytes() for x, t in (([i for w in words for i in w], "<i4"), ([len(w) for w in words], "<i4"), ([r.randrange(1, 5) for _ in words], "<i8"))]
    chunk, before = Chunk(*row), None
    before = chunk.totals()
    for t, (a, b) in enumerate([(0, 1), (1, 1), (2, 0), (4, 2), (3, 3), (5, 4)], 4):
        chunk.apply({pair(a, b): t})
        after = chunk.totals()
        assert chunk.last == {p: after.get(p, 0) - before.get(p, 0) for p in {*after, *before} if after.get(p, 0) != before.get(p, 0)}
        assert all(any(q == p for q in (pair(x, y) for x, y in zip(chunk.words[k], chunk.words[k][1:]))) is False or k in chunk.postings[p]
                   for p in chunk.postings for k in range(len(chunk.words)))
        before = after


def test_long_words_encode_like_the_tokenizers_package(spark):
    tok, ref = reference(140)
    lines = spark.createDataFrame([(r,) for r in RECORDS], "value string")
    vocab, merges = bpe.train_bpe(bpe.word_counts(bpe.corpus_sequences(lines)), vocab_size=140)
    import random
    import time

    r = random.Random(2)
    long = ["".join(r.choice("helowrdtnqu") for _ in range(100_000)), "o" * 100_000, "hello" * 20_000]
    t0 = time.time()
    got = {x["k"]: list(x["ids"]) for x in bpe.encode_texts(spark.createDataFrame(list(enumerate(long)), "k long, value string"), ["k"], "value", vocab, merges).collect()}
    assert time.time() - t0 < 60
    assert all(got[k] == tok.encode(t).ids for k, t in enumerate(long))


def test_the_corpus_is_read_once_and_chunks_are_arrays(spark):
    """Training cuts the corpus into words once, and a chunk holds some bytes a symbol, not a set of words per pair."""
    import numpy as np

    from corpusflow.operators.bpe_rounds import Chunk

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    words = spark.createDataFrame(list(random_words(3).items()), "word string, n long")
    bpe.train_bpe(words.mapInArrow(count, words.schema), vocab_size=12)
    assert seen.value == words.count()
    flat = np.random.default_rng(1).integers(0, 50, 100_000)
    chunk = Chunk(flat.astype("<i4").tobytes(), np.full(10_000, 10, "<i4").tobytes(), np.ones(10_000, "<i8").tobytes())
    assert sum(x.nbytes for x in vars(chunk).values() if isinstance(x, np.ndarray)) < 12 * len(flat)
