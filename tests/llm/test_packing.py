import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from helpers import clashing, documents, odd_texts, prose
from tokenizers import Tokenizer

from corpusflow.llm import packing as K

PATH = P.path("word_bpe_49k.json")


def optimum(lengths, capacity):
    """Fewest bins, by trying every bin for every item."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j, room in sorted(set((r, j) for j, r in enumerate(bins)))[:]:
            pass
        seen = set()
        for j in range(len(bins)):
            if bins[j] >= lengths[k] and bins[j] not in seen:
                seen.add(bins[j])
                bins[j] -= lengths[k]
                go(k + 1, bins)
                bins[j] += lengths[k]
        go(k + 1, bins + [capacity - lengths[k]])

    go(0, [])
    return best[0]


def test_plan_holds_all_pieces_and_is_near_the_optimum():
    rng = np.random.default_rng(5)
    worse = 0
    for _ in range(150):
        lengths = rng.integers(1, 31, rng.integers(0, 11)).tolist()
        counts = np.bincount(lengths, minlength=31)
        uses = K.plan(counts, 30)
        held = np.zeros(31, int)
        for u in uses:
            assert sum(u.lengths) <= 30
            for x in u.lengths:
                held[x] += u.times
        assert (held == counts).all()
        n = sum(u.times for u in uses)
        assert n <= sum(u.times for u in K.best_fit(counts, 30))
        worse += n - optimum(lengths, 30)
    assert worse == 0


def test_branch_and_bound_beats_best_fit():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # best fit needs four bins of ten for the sum of 30
    counts = np.bincount(lengths, minlength=11)
    assert sum(u.times for u in K.plan(counts, 10)) == 3


def test_full_fillings_of_several_pieces_branch():
    lengths = [7, 5, 4, 4, 4, 4, 4, 4, 2, 1]  # 13 = 7 + 5 + 1 leaves even pieces only, which cannot fill 13
    counts = np.bincount(lengths, minlength=14)
    assert sum(u.times for u in K.plan(counts, 13)) == 3


def test_a_filling_may_be_used_less_often_than_it_could():
    rng = np.random.default_rng(8)
    for _ in range(150):
        lengths = np.repeat(rng.integers(1, 14, 4), rng.integers(1, 4, 4)).tolist()
        uses = K.plan(np.bincount(lengths, minlength=21), 20)
        assert sorted(x for u in uses for x in u.lengths * u.times) == sorted(lengths)
        assert sum(u.times for u in uses) == optimum(lengths, 20)


def test_query_equals_the_tokenizer_and_has_no_gaps(spark):
    rows = odd_texts() + [(40 + k, prose(k, 30 + 97 * k)) for k in range(25)] + [(80, "Don't stop\x1cnow <|endoftext|> é"), (81, "w" * 1000)]
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((i, n, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    got = K.pack(clashing(documents(spark, rows)), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(
        want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(x[3] for x in want) // 4096) + 1
    assert K.pack(documents(spark, rows).limit(0), PATH).count() == 0


def test_lower_bound_is_one():
    rng = np.random.default_rng(11)
    for _ in range(200):
        lengths = rng.integers(1, 31, rng.integers(1, 10)).tolist()
        assert K.lower_bound(np.bincount(lengths, minlength=31), 30) <= optimum(lengths, 30)
    assert K.lower_bound(np.bincount([1366] * 1000, minlength=4097), 4096) == 500  # two of three thirds and a bit
    assert K.lower_bound(np.bincount([2049] * 7 + [3000], minlength=4097), 4096) == 8


def test_lengths_of_a_third_need_no_search(monkeypatch):
    monkeypatch.setattr(K, "fillings", None)  # a search would fail
    assert sum(u.times for u in K.plan(np.bincount([1366] * 1000, minlength=4097))) == 500


def test_sequences_of_long_middling_and_short_pieces():
    lengths = np.random.default_rng(5).integers(1200, 1601, 3000)
    uses = K.plan(np.bincount(lengths, minlength=4097))
    held = np.zeros(4097, int)
    for u in uses:
        assert sum(u.lengths) <= 4096
        for x in u.lengths:
            held[x] += u.times
    assert (held == np.bincount(lengths, minlength=4097)).all()
    assert sum(u.times for u in uses) <= 1127  # best-fit decreasing: 1188


def test_first_solutions_may_split_at_every_length(monkeypatch):
    """The splits are narrowed to neighbouring lengths, also with more than 2,000 of them."""
    splits, real = [], K.balanced
    monkeypatch.setattr(K, "balanced", lambda counts, capacity, split: splits.append(split) or real(counts, capacity, split))
    counts = np.zeros(4097, np.int64)
    counts[1:2501] = 1
    assert all(sorted(x for u in found for x in u.lengths * u.times) == list(range(1, 2501)) for found in K.incumbents(counts, 4096))
    assert {b - a for a, b in zip(sorted(splits), sorted(splits)[1:])} >= {1} and len(splits) < 100
