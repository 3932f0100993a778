"""Packing by first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's ids are cut into pieces of the capacity; a full piece is a
sequence of its own.  What is left of each document goes to a group by a random
number, and groups are packed independently, so the work spreads over the
cluster and a group's size does not depend on ids or texts.

In a group, pieces go longest first to the first bin with room.  The bins'
room is kept in a tournament tree, whose inner nodes hold the larger of their
two children, so the first bin with room is found in steps of the tree's
height.  As documents may be cut, the emptiest bins are then taken apart to
fill the gaps of the others, and what is left at the end is cut into sequences
whose lengths are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpoint, pick, slices
from .packing import worker_ids

CAPACITY = 4096
END_ID = 2
#: Documents a group holds on average; at most ``CAPACITY`` ids of 4 bytes each.
GROUP = 4096
SEED = 12
#: Entries of a worker's two caches of encoded words (some 200 bytes each).
CACHE_CHUNKS, CACHE_PARTS = 60_000, 600_000
#: Places for the sequence numbers of a group, and the bit that marks sequences of one full piece.
_PER_GROUP, _FULL, _PER_PART = 1 << 20, 1 << 62, 1 << 40

PLACED = "id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class TournamentTree:
    """Room left in each bin; finds the first bin with enough."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        """The first bin with room for ``size`` (one must have it); its room shrinks by that."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        room[k] -= size
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of piece numbers; every length is at most ``capacity``."""
    tree, bins = TournamentTree(len(lengths), capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        b = tree.first(lengths[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def fill(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, from, length): full ones, and at most one of each power of two below the capacity.

    Bins are taken in order of their filling.  The least filled one gives its
    pieces, whole or in part, to the gaps of the fullest ones; the last one left
    is cut at the powers of two that its length is made of.
    """
    open_ = deque(sorted(([(k, 0, lengths[k]) for k in b] for b in bins), key=lambda b: -sum(p[2] for p in b)))
    out: list[list[tuple[int, int, int]]] = []
    while open_:
        own = open_.popleft()
        room = capacity - sum(p[2] for p in own)
        while room and open_:
            giver = open_[-1]
            k, at, n = giver.pop()
            take = min(n, room)
            own.append((k, at, take))
            if take < n:
                giver.append((k, at + take, n - take))
            if not giver:
                open_.pop()
            room -= take
        if room and not open_:  # the last one
            rest, left = own, capacity - room
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    part, rest = _split(rest, 1 << bit)
                    out.append(part)
        else:
            out.append(own)
    return out


def _split(pieces: list[tuple[int, int, int]], size: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The first ``size`` ids of ``pieces`` and the rest."""
    head, tail = [], []
    for k, at, n in pieces:
        take = min(n, size)
        if take:
            head.append((k, at, take))
        if take < n:
            tail.append((k, at + take, n - take))
        size -= take
    return head, tail


def id_bytes(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold any id: two where the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _recode(ids: bytes, old: int, new: int) -> bytes:
    return ids if old == new else np.frombuffer(ids, f"<u{old}").astype(f"<u{new}").tobytes()


def token_rests(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, width: int) -> DataFrame:
    """One row per piece of ``capacity`` ids (placed) and one per rest (with its ids, ``width`` bytes each).

    Rests are told apart by task and row number (``part``, ``row``), so the
    rows must be stored before use.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    key, shared = ("ids", len(data), zlib.crc32(data)), spark.sparkContext.broadcast(data)  # a vocabulary file of a few MB
    schema = spark.createDataFrame([], f"{PLACED.format(id=dict(docs.dtypes)['id'])}, part int, row bigint, ids binary").schema
    arrow = to_arrow_schema(schema)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = worker_ids(key, shared, CACHE_CHUNKS, CACHE_PARTS), TaskContext.get().partitionId()
        full = row = 0
        for batch in batches:
            for some in slices(batch, 4 << 20):
                owners, cols = [], [[] for _ in range(8)]
                for k, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()])):
                    ids += end
                    total, cut = len(ids) // 4, len(ids) // (4 * capacity) * capacity
                    for at in range(0, cut, capacity):
                        owners.append(k)
                        whole = zlib.crc32(ids[4 * at:4 * (at + capacity)])
                        for col, x in zip(cols, (at, capacity, whole, total, _FULL + part * _PER_PART + full, 0, None, None)):
                            col.append(x)
                        full += 1
                    if cut < total:
                        owners.append(k)
                        for col, x in zip(cols, (cut, total - cut, None, total, None, None, row, _recode(ids[4 * cut:], 4, width))):
                            col.append(x)
                    row += 1
                arrays = [some.column("id").take(pa.array(owners, pa.int64()))]
                for name, col in zip(("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row", "ids"), cols):
                    arrays.append(pa.array(col, arrow.field(name).type))
                arrays.insert(7, pa.array([part] * len(owners), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's ids and ``end_id``.  Every sequence is
    ``capacity`` long, but for at most one of each smaller power of two in each
    group, so none needs padding (``capacity`` must be a power of two).  Null
    and empty texts are the end id alone.  Null ids pass through; repeated rows
    are packed each; an empty table gives an empty result.
    """
    width = id_bytes(tokenizer_path, end_id)
    stored = checkpoint(token_rests(pick(docs, id=id_col, text=text_col), tokenizer_path, capacity, end_id, width))
    rests = stored.where(F.col("ids").isNotNull())
    groups = max(1, -(-rests.count() // group))
    out = PLACED.format(id=dict(docs.dtypes)[id_col])
    names = [f.split()[0] for f in out.split(", ")]
    dealt = rests.select("id", "start", "length", "doc_tokens", "part", "row", "ids",
                         F.pmod(F.xxhash64("part", "row", F.lit(seed)), F.lit(groups)).alias("group"))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("row", "ascending")])
        ids, lengths = [_recode(b, width, 4) for b in rows.column("ids").to_pylist()], rows.column("length").to_pylist()
        owner, sequence, offset, start, length, crc = found = [[] for _ in range(6)]
        for number, pieces in enumerate(fill(first_fit_decreasing(lengths, capacity), lengths, capacity)):
            at = 0
            for k, begin, n in pieces:
                for col, x in zip(found, (k, key[0].as_py() * _PER_GROUP + number, at, begin, n, zlib.crc32(ids[k][4 * begin:4 * (begin + n)]))):
                    col.append(x)
                at += n
        of = rows.select(["id", "start", "doc_tokens"]).take(pa.array(owner, pa.int64()))
        begin = np.array(of.column("start").to_pylist(), np.int64) + np.array(start, np.int64)
        return pa.table([of.column("id"), pa.array(begin), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), of.column("doc_tokens"),
                         pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    packed = dealt.groupBy("group").applyInArrow(place, out)
    return stored.where(F.col("ids").isNull()).select(*names).unionAll(packed).withColumnRenamed("id", id_col)
