import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from helpers import clashing, documents, odd_texts, prose
from tokenizers import Tokenizer

from corpusflow.llm import group_packing as G

PATH = P.path("word_bpe_49k.json")


def plain_first_fit(lengths, capacity):
    bins, room = [], []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = next((b for b, r in enumerate(room) if r >= lengths[k]), None)
        if b is None:
            bins.append([])
            room.append(capacity)
            b = len(bins) - 1
        bins[b].append(k)
        room[b] -= lengths[k]
    return bins


def test_tree_finds_what_a_scan_finds():
    r = random.Random(3)
    for _ in range(200):
        lengths = [r.randint(1, 64) for _ in range(r.randint(1, 60))]
        assert G.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


def test_filling_leaves_no_padding():
    r = random.Random(4)
    for _ in range(200):
        lengths = [r.randint(1, 63) for _ in range(r.randint(1, 60))]
        out = G.fill(G.first_fit_decreasing(lengths, 64), lengths, 64)
        seen = defaultdict(list)
        for s in out:
            for k, at, n in s:
                seen[k].append((at, n))
        for k, length in enumerate(lengths):
            at = 0
            for a, n in sorted(seen[k]):
                assert a == at and n > 0
                at += n
            assert at == length
        sizes = [sum(n for _, _, n in s) for s in out]
        assert sizes.count(64) == sum(lengths) // 64
        small = [s for s in sizes if s < 64]
        assert len(small) == len(set(small)) and all(s & (s - 1) == 0 for s in small)


def check(docs, rows, capacity, end=2):
    """Each id of each document is in one piece; sequences are gapless and at a power of two."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        want[i, tuple(ids)] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for (i, ids), copies in want.items():
        pieces = by_doc[i, len(ids)]
        data = np.array(ids, "<u4").tobytes()
        ours = [p for p in pieces if zlib.crc32(data[4 * p[0]:4 * (p[0] + p[1])]) == p[2]]
        assert sum(p[1] for p in ours) >= copies * len(ids)
        assert {x for s, n, _ in ours for x in range(s, s + n)} == set(range(len(ids)))
    assert sum(r.length for r in rows) == sum(len(ids) * c for (_, ids), c in want.items())
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and at & (at - 1) == 0
    return by_sequence


def test_odd_documents(spark):
    docs = odd_texts() + [(20 + k, prose(k, 50 + 11 * k)) for k in range(60)]
    df = documents(spark, docs)
    rows = G.pack(df, PATH).collect()
    check(docs, rows, 4096)
    wide = G.pack(clashing(df), PATH)
    assert wide.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(map(repr, wide.collect())) == sorted(map(repr, G.pack(df, PATH).collect()))
    assert G.pack(documents(spark, []), PATH).collect() == []


def test_many_groups_and_a_hot_text(spark):
    docs = [(k, prose(k, 5 + k % 90)) for k in range(200)] + [(None, "the same text again")] * 150 + [(7, prose(5, 400))] * 3
    sequences = check(docs, G.pack(documents(spark, docs).repartition(4), PATH, capacity=128, group=40).collect(), 128)
    groups = defaultdict(list)
    for s, places in sequences.items():
        if s < G._FULL:
            groups[s >> 20].append(sum(n for _, n in places))
    assert len(groups) >= 8
    for sizes in groups.values():
        assert len([x for x in sizes if x < 128]) == len({x for x in sizes if x < 128})
