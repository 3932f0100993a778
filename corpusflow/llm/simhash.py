"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last
filled up with zeros).  The binary Golay code of length 23 is perfect: every
23-bit word is within 3 bits of exactly one of 4,096 codewords.  A segment's
keys are the indices of the codewords that its neighbours at distance at most
one decode to: one key if it is within two bits of a codeword, else six.  Two
segments that differ in at most two bits have a word between them at distance
at most one of both, so they share a key.

Pigeonhole: four differing bits over three segments leave at least two segments
with at most two each.  So fingerprints are keyed by every pair of segments and
every pair of their keys (3 to 108 keys of 24 bits), and any two within four
bits share one.  Rows with the same key are joined and verified by the number
of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, pick, positional, small
from .components import components

SHINGLE = 4
MAX_BITS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a generator polynomial of the code
#: Fingerprints of one key that a task compares with each other; a key that has more is cut into blocks.
BLOCK = 50_000
#: Fingerprints whose keys one task makes (some hundred keys each).
KEYED = 20_000
#: Keys with more are found from the fingerprints whose hash is a multiple of this (which keys are cut changes no result).
SAMPLE = 64
#: Ids (8 bytes each) that are still broadcast to remove documents; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
_LOWER = {k: k + 32 for k in range(65, 91)}
_GAPS = {k: " " for k in (9, 10, 11, 12, 13)}


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the XXH64 (seed 42) hashes of the word shingles, with repeats.

    Words are runs of characters other than ASCII white space, A-Z in lower
    case.  Fewer words than a shingle make one shingle, none make fingerprint 0.
    """
    data = " ".join(filter(None, text.translate(_GAPS).split(" "))).encode("utf-8", "surrogatepass").lower()
    if not data:
        return 0
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    if len(gaps) < shingle - 1:
        return xxhash.xxh64_intdigest(data, 42)
    starts = np.concatenate(([0], gaps + 1))[: len(gaps) + 2 - shingle].tolist()
    ends = np.concatenate((gaps, [len(data)]))[shingle - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 8192):
        h = np.array([digest(data[a:b], 42) for a, b in zip(starts[at:at + 8192], ends[at:at + 8192])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null text counts as empty."""
    def row(text: str) -> tuple[int]:
        f = fingerprint(text, shingle)
        return (f - (1 << 64) if f >> 63 else f,)

    return map_texts(pick(docs, id=id_col, text=text_col), "fp bigint", row, "id")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial (11 bits)."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> np.uint32(bit)) & 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


def error_table() -> np.ndarray:
    """The error pattern of weight at most 3 of each of the 2,048 syndromes."""
    patterns = [0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(23), n)]
    words = np.array(patterns, np.uint32)
    table = np.zeros(2048, np.uint32)
    table[syndromes(words)] = words
    return table


def segment_keys(words: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; repeats of a row's first key are -1.

    A word at distance 3 from its codeword has neighbours that decode to five
    other codewords; any other word's neighbours all decode to its own.
    """
    out = np.full((len(words), 6), -1, np.int32)
    own = words ^ errors[syndromes(words)]
    out[:, 0] = own >> np.uint32(11)
    far = np.flatnonzero(np.bitwise_count(words ^ own) == 3)
    near = words[far, None] ^ (np.uint32(1) << np.arange(23, dtype=np.uint32))[None, :]
    flat = near.ravel()
    decoded = np.sort(((flat ^ errors[syndromes(flat)]) >> np.uint32(11)).reshape(near.shape).astype(np.int32), axis=1)
    first = np.concatenate([np.ones((len(far), 1), bool), decoded[:, 1:] != decoded[:, :-1]], axis=1)
    first &= decoded != out[far, 0][:, None]
    rank = np.cumsum(first, axis=1)
    r, c = np.nonzero(first)
    out[far[r], rank[r, c]] = decoded[r, c]
    return out


def bucket_keys(fps: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of unsigned 64-bit fingerprints; a key holds the segment pair and two codeword indices."""
    keys = [segment_keys(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32), errors) for at, n in SEGMENTS]
    rows, out = [], []
    for which, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = keys[i][:, :, None], keys[j][:, None, :]
        r, x, y = np.nonzero((a >= 0) & (b >= 0))
        rows.append(r)
        out.append((np.int64(which) << 24) | (keys[i][r, x].astype(np.int64) << 12) | keys[j][r, y])
    return np.concatenate(rows), np.concatenate(out)


def spanning(fps: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links that join, within one bucket, all fingerprints connected by steps of at most ``most`` bits.

    A breadth-first walk over the unvisited members: at most one link per
    member, whatever the number of pairs within the distance.
    """
    left, right = [], []
    open_ = np.arange(len(fps))
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            k = front.pop()
            near = np.bitwise_count(fps[open_] ^ fps[k]) <= most
            hit = open_[near]
            left += [k] * len(hit)
            right += hit.tolist()
            front += hit.tolist()
            open_ = open_[~near]
    return left, right


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(a, b): nodes whose fingerprints differ in at most ``max_bits`` bits, enough to connect all such nodes.

    ``distinct`` has one row (fp, node) per fingerprint, so a group of copies is
    one row here.  Rows meet by key: they are dealt out by key and sorted, and a
    task walks through its keys, holding one key's fingerprints at a time.  Per
    key at most one link per fingerprint comes out.  A key that very many
    fingerprints share is cut into blocks by their hash, and every pair of
    blocks becomes a key of its own, so no task holds more than about two blocks.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the segments' keys cover at most four differing bits")
    errors = error_table()

    blocks: dict[int, int] = {}  # blocks of the keys that are cut

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.array(sorted(blocks), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column("fp").to_numpy(zero_copy_only=False)
                node = part.column("node").to_numpy(zero_copy_only=False)
                rows, keys = bucket_keys(fp.view(np.uint64), errors)
                cut = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
                out, owner = [keys[~cut]], [rows[~cut]]
                for r, k in zip(rows[cut].tolist(), keys[cut].tolist()):
                    n = blocks[k]
                    own = int(fp[r]) * 0x9E3779B97F4A7C15 % (1 << 64) * n >> 64
                    pairs = [min(own, b) * n + max(own, b) for b in range(n)]
                    out.append(np.array([(p + 1 << 26) | k for p in pairs], np.int64))
                    owner.append(np.full(n, r))
                owner, keys = np.concatenate(owner), np.concatenate(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(fp[owner]), pa.array(node[owner])], names=["key", "fp", "node"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last key seen so far

        def out(key, fp, node):
            change = np.flatnonzero(np.diff(key)) + 1
            begin = np.concatenate(([0], change))
            size = np.diff(np.concatenate((begin, [len(key)])))
            a, b = [], []
            two = begin[size == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            a.append(node[close])
            b.append(node[close + 1])
            for s, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
                x, y = spanning(fp[s:s + n], max_bits)
                a.append(node[s:s + n][x])
                b.append(node[s:s + n][y])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("key").to_numpy(zero_copy_only=False),
                         batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64),
                         batch.column("node").to_numpy(zero_copy_only=False)))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # one key so far
            key, fp, node = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            yield out(key[:cut], fp[:cut], node[:cut])
            held = [(key[cut:], fp[cut:], node[cut:])]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    spread_over = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // KEYED))
    distinct = distinct.repartition(spread_over, "fp")  # a row makes up to 108
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0).mapInArrow(keyed, "key bigint, fp bigint, node bigint")
    for r in few.groupBy("key").count().where(F.col("count") * sample > block).collect():  # a key per `block` rows at most
        blocks[r["key"]] = min(-(-r["count"] * sample // block), 1 << 18)
    spread = distinct.mapInArrow(keyed, "key bigint, fp bigint, node bigint")
    sorted_ = spread.repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(verified, "a bigint, b bigint").distinct()


def least_of_component(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, n): for each fingerprint of ``fps`` (fp, key), the least ``key`` of its component and its rows.

    The fingerprints are the nodes, so rows of one id are linked only if their
    fingerprints are.  Null keys count as none: ``least`` is null in a component
    without any other.  The result is stored.
    """
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("key").alias("own"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct.select("fp", F.col("fp").alias("node")), max_bits)).withColumnRenamed("node", "fp")
    linked = checkpoint(distinct.join(found, "fp"))
    least = linked.groupBy("component").agg(F.min("own").alias("least"))
    linked = linked.join(least, "component").select("fp", F.lit(True).alias("_linked"), "least")
    return checkpoint(distinct.join(linked, "fp", "left").select(
        "fp", F.when(F.col("_linked"), F.col("least")).otherwise(F.col("own")).alias("least"), "n"))


def with_least(fps: DataFrame, known: DataFrame) -> DataFrame:
    """``fps`` with the ``least`` of its fingerprint, from ``known`` (fp, least, n).

    A fingerprint that a large share of all rows has would land in one task.
    Those with more rows than half a partition's share are at most twice as many
    as there are partitions, so they are broadcast and their rows stay where
    they are; only the others are shuffled.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = (known.agg(F.sum("n")).first()[0] or 0) // (2 * parts) + 1
    hot = F.broadcast(known.where(F.col("n") > share).select("fp", "least"))  # at most 2 * parts rows
    cold = known.where(F.col("n") <= share).select("fp", "least")
    return fps.join(hot, "fp").unionByName(fps.join(hot, "fp", "left_anti").join(cold, "fp"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Documents whose fingerprints differ in at most ``max_bits`` bits are linked;
    texts without a word all have fingerprint 0 and are linked like any other.
    Copies are grouped by fingerprint before the search.  Ids are integers; rows
    without one link like any other but give no smallest id, so a component
    without ids is null.  Repeated rows give repeated rows; rows that repeat an
    id with unlike texts are not linked by it; an empty table gives an empty
    result.
    """
    fps = checkpoint(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    known = least_of_component(fps.select("fp", F.col("id").cast("bigint").alias("key")), max_bits)
    return with_least(fps, known).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                         F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """``docs``, all columns, with one row of each component: one with its smallest id.

    Rows are told apart by id and a digest of the text; of the texts with the
    smallest id the one with the least digest stays.  Rows without an id come
    after all others, so a component of such rows alone keeps one of them.  Only
    ids and digests are shuffled while few documents go; rows that repeat both
    are looked at again, to keep one of them.  Null texts count as empty, and an
    empty table gives an empty result.
    """
    rows, own = positional(docs), f"_in{docs.columns.index(id_col)}"
    digest = F.xxhash64(f"_in{docs.columns.index(text_col)}")  # equal digests matter only within an id
    key = F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), digest.alias("digest"))
    keyed = rows.select(key.alias("key"), F.col(f"_in{docs.columns.index(text_col)}").alias("text"))
    fps = checkpoint(fingerprints(keyed, id_col="key", text_col="text", shingle=shingle).withColumnRenamed("id", "key"))
    found = with_least(fps, least_of_component(fps, max_bits)).select(
        F.col("key.id").alias("_id"), F.col("key.digest").alias("_digest"), F.col("key").eqNullSafe(F.col("least")).alias("_first"))
    found = checkpoint(found.groupBy("_id", "_digest", "_first").count())
    gone = checkpoint(found.where("not _first").select("_id", "_digest"))
    again = checkpoint(found.where("_first and count > 1").select("_id", "_digest"))
    gone_, again_ = (small(x, BROADCAST_ROWS // 2) for x in (gone, again))  # two numbers each
    on = [F.col(own).eqNullSafe(F.col("_id")), digest == F.col("_digest")]
    left = rows.join(gone_, on, "left_anti")
    if not again.isEmpty():
        one = rows.join(again_, on, "left_semi").withColumn("_digest", digest).dropDuplicates([own, "_digest"]).drop("_digest")
        left = left.join(again_, on, "left_anti").unionByName(one)
    return left.toDF(*docs.columns)
