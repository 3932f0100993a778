import random
import re

import numpy as np
import xxhash
from helpers import clashing, documents, odd_texts, prose

from pyspark.sql import functions as F

from corpusflow.llm import simhash as H
from corpusflow.llm.common import pick
from corpusflow.llm.components import components


def fingerprint(text):
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    rows = [(i, fingerprint(t)) for i, t in rows if i is not None]
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1:]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, f in rows:
        least[find(f)] = min(least.get(find(f), i), i)
    return {i: (f"{f:016x}", least[find(f)]) for i, f in rows}


def near(seed, n):
    r, out = random.Random(seed), []
    base = prose(seed, 300).split()
    for k in range(n):
        w = list(base)
        w[r.randrange(len(w))] = f"x{k}"
        out.append((1000 * seed + k, " ".join(w)))
    return out


def test_equals_brute_force(spark):
    rows = [x for x in odd_texts()] + [x for s in range(2, 8) for x in near(s, 25)] + [(9000 + k, prose(k, 5 + k)) for k in range(60)]
    got = H.near_duplicates(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    # of the rows without an id one is like nothing else, one is empty like documents 3, 4 and 5
    assert sorted([r.component_id for r in got if r.doc_id is None], key=str) == [3, None]
    assert len({c for _, c in want.values()}) < len(want) - 60


def test_keys_cut_into_blocks_lose_no_link(spark):
    rows = [x for s in range(2, 5) for x in near(s, 40)]
    fps = sorted({fingerprint(t) for _, t in rows})
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp bigint, node bigint")
    whole, cut = ({r.node: r.component for r in components(H.links(distinct, **o)).collect()} for o in ({}, {"block": 5, "sample": 1}))
    assert whole == cut and len(whole) > 20


def test_chains_are_one_component(spark):
    a = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(a).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_golay_keys_cover_four_bits():
    errors, rng = H.error_table(), np.random.default_rng(1)
    assert len(set(errors.tolist())) == 2048
    f = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    g = f.copy()
    for _ in range(4):
        g ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    sets = []
    for x in (f, g):
        own = [set() for _ in x]
        for r, k in zip(*(a.tolist() for a in H.bucket_keys(x, errors))):
            own[r].add(k)
        sets.append(own)
    assert all(a & b for a, b in zip(*sets))


def test_keep_first(spark):
    rows = odd_texts() + near(3, 10)
    docs = clashing(documents(spark, rows))
    kept = H.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.i for r in pick(kept, i="doc_id").collect() if r.i is not None)
    assert ids == sorted({c for _, c in brute(rows).values()})
    assert pick(kept, i="doc_id").where("i is null").count() == 1  # that which is like nothing else


def kept_rows(spark, rows):
    docs = clashing(documents(spark, rows))
    kept = H.keep_first(docs)
    assert kept.columns == docs.columns
    return [(r.i, r.t) for r in pick(kept, i="doc_id", t="text").collect()]


def test_ids_that_repeat_with_unlike_texts(spark):
    x, y, z = (prose(s, 80) for s in (21, 22, 23))
    rows = [(3, x), (5, x), (5, y), (8, y), (6, z), (6, x), (9, z.replace(" ", "  ")), (9, z)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in H.near_duplicates(documents(spark, rows)).collect()}
    assert got == {(i, f"{fingerprint(t):016x}", {x: 3, y: 5}.get(t, 6)) for i, t in rows}
    assert sorted(kept_rows(spark, rows)) == sorted([(3, x), (5, y), (6, z)])
    assert sorted(kept_rows(spark, [(5, x), (5, y)])) == sorted([(5, x), (5, y)])
    assert sorted(kept_rows(spark, [(5, x), (5, y), (5, x), (5, y), (7, y)])) == sorted([(5, x), (5, y)])
    spaced = kept_rows(spark, [(4, z), (4, z.replace(" ", "  ")), (4, z), (None, z), (4, None), (4, ""), (5, None)])
    assert len(spaced) == 2 and (None, z) not in spaced


def test_rows_without_an_id_are_links(spark):
    """A middle text joins two others, whether it has an id or not; rows without an id count once."""
    r = random.Random(3)
    base, words = prose(31, 400).split(), []
    while len(words) < 3:  # three texts in a chain of fingerprints, the ends further apart than four bits
        chain = [list(base)]
        for _ in range(2):
            w = list(chain[-1])
            for k in r.sample(range(len(w)), r.randint(1, 12)):
                w[k] = f"y{r.randrange(10 ** 6)}"
            chain.append(w)
        f = [fingerprint(" ".join(w)) for w in chain]
        if (f[0] ^ f[1]).bit_count() <= 4 and (f[1] ^ f[2]).bit_count() <= 4 < (f[0] ^ f[2]).bit_count():
            words = chain
    a, b, c = (" ".join(w) for w in words)
    for middle in (2, None):
        got = {r.fingerprint: r.component_id for r in H.near_duplicates(documents(spark, [(1, a), (middle, b), (3, c)])).collect()}
        assert set(got.values()) == {1} and len(got) == 3
    assert kept_rows(spark, [(None, b), (3, c), (1, a)]) == [(1, a)]
    assert kept_rows(spark, [(None, a), (None, a), (5, a)]) == [(5, a)]
    assert len(kept_rows(spark, [(None, a), (None, a), (None, b)])) == 1
    assert {r.component_id for r in H.near_duplicates(documents(spark, [(None, a), (None, b)])).collect()} == {None}


def test_a_hot_fingerprint_is_not_dealt_by_key(spark):
    """Half of all rows are copies: their rows meet a broadcast row, the others are joined by shuffle."""
    rows = [(k, prose(40, 50)) for k in range(400)] + [(1000 + k, prose(50 + k, 50)) for k in range(400)]
    docs = documents(spark, rows)
    fps = H.fingerprints(docs, id_col="doc_id", text_col="text").cache()
    known = H.least_of_component(fps.select("fp", F.col("id").alias("key")), 4)
    joined = H.with_least(fps, known)
    assert {r.id: r.least for r in joined.collect()} == {i: 0 if i < 1000 else i for i, _ in rows}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = known.where(F.col("n") > len(rows) // (2 * parts) + 1).count()
    assert hot == 1
    fps.unpersist()


def test_empty(spark):
    docs = documents(spark, odd_texts()).limit(0)
    assert H.near_duplicates(docs).count() == 0 and H.keep_first(docs).count() == 0
