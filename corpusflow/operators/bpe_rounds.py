"""B1: rounds of BPE merges that touch only the words holding a merged pair.

The distinct words are dealt into chunks of a bounded size, one stored row per
chunk.  A chunk's worker keeps its words as one array of symbols from round to
round; a round finds the merged pairs by numpy, rewrites them and gives out how
the pair counts changed around them.  A worker that has missed rounds catches
up from the merge log, and one that has nothing begins with the stored row, so
a lost executor costs time and no result.

The driver keeps the counts of the most frequent pairs (``Head``, at most
``HEAD`` of them) and adds the changes.  A pair outside is known to be below
the head's floor, and merges only lower its count, so it cannot matter before
the head has sunk to the floor; then the head is read anew.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.session import cut_lineage

#: Pairs whose counts the driver keeps (some 100 bytes each).
HEAD = 500_000
#: Symbols of a chunk, beside its number of words.
CHUNK_SYMBOLS = 500_000
#: Symbols that a worker keeps over all its chunks (some 10 bytes each); the chunk used longest ago goes first and is
#: rebuilt if it comes back.
KEPT_SYMBOLS = 20_000_000
_SHIFT = 32  # token ids stay below 2^31: a << 32 | b names a pair
_LOW = (1 << _SHIFT) - 1
_END = -1  # after every word of a chunk

#: Merges of a round: pair -> new token.
Round = dict[int, int]


def pair(a: int, b: int) -> int:
    return a << _SHIFT | b


class Chunk:
    """Words of one chunk after ``applied`` rounds, as one array of symbols.

    Every word is followed by ``_END``, so pairs never span two words.  A round
    is some passes of numpy over the array, and the counts change only where a
    merged symbol or its neighbour stands.
    """

    def __init__(self, symbols: bytes, lengths: bytes, counts: bytes):
        flat, ends = np.frombuffer(symbols, "<i4"), np.cumsum(np.frombuffer(lengths, "<i4"), dtype=np.int64)
        self.flat = np.insert(flat, ends, _END)
        self.of = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0) + 1)
        self.counts = np.frombuffer(counts, "<i8")
        self.symbols, self.applied, self.touched = len(flat), 0, 0
        self.changed = _summed_pairs(np.empty(0, np.int64), np.empty(0, np.int64))

    def _pairs_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at ``at`` inside a word, and how often each counts."""
        x, y = self.flat[at], self.flat[at + 1]
        inside = (x != _END) & (y != _END)
        return x[inside].astype(np.int64) << _SHIFT | y[inside], self.counts[self.of[at[inside]]]

    def _matches(self, keys: np.ndarray) -> np.ndarray:
        """Where a pair of ``keys`` (sorted) is merged: of overlapping equals every second one, from the left."""
        left, right = (np.zeros(max(int(self.flat.max(initial=0)), int((keys >> _SHIFT).max()), int((keys & _LOW).max())) + 2, bool) for _ in range(2))
        left[keys >> _SHIFT], right[keys & _LOW] = True, True  # the last entry, which _END (-1) reads, stays False
        at = np.flatnonzero(left[self.flat[:-1]] & right[self.flat[1:]])
        p = self.flat[at].astype(np.int64) << _SHIFT | self.flat[at + 1]
        at = at[keys[np.minimum(np.searchsorted(keys, p), len(keys) - 1)] == p]
        if len(at):
            starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)  # runs of places side by side
            at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))) % 2 == 0]
        return at

    def apply(self, merges: Round, changes: bool = True) -> None:
        """Merge; ``changed`` is how the pair counts changed (not made without ``changes``)."""
        keys = np.array(sorted(merges), np.int64)
        made = np.array([merges[k] for k in keys.tolist()], np.int32)
        at = self._matches(keys)
        pairs: list[np.ndarray] = []
        numbers: list[np.ndarray] = []

        def around(places: np.ndarray, sign: int) -> None:
            p, n = self._pairs_at(places)
            pairs.append(p)
            numbers.append(sign * n)

        if changes:
            self.touched = len(np.unique(self.of[at]))
            old = np.unique(np.concatenate((at - 1, at, at + 1)))
            around(old[old >= 0], -1)
        self.flat = self.flat.copy()
        self.flat[at] = made[np.searchsorted(keys, self.flat[at].astype(np.int64) << _SHIFT | self.flat[at + 1])]
        keep = np.ones(len(self.flat), bool)
        keep[at + 1] = False
        self.flat, self.of = self.flat[keep], self.of[keep]
        if changes:
            new = at - np.arange(len(at))  # one symbol less for every match before
            new = np.unique(np.concatenate((new - 1, new)))
            around(new[new >= 0], 1)
            self.changed = _summed_pairs(np.concatenate(pairs), np.concatenate(numbers))
        self.applied += 1

    def pair_totals(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed_pairs(*self._pairs_at(np.arange(max(0, len(self.flat) - 1))))

    @property
    def last(self) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.changed)))

    def totals(self) -> dict[int, int]:
        return dict(zip(*(x.tolist() for x in self.pair_totals())))

    @property
    def words(self) -> list[list[int]]:
        return [w[:-1].tolist() for w in np.split(self.flat, np.flatnonzero(self.flat == _END) + 1)[:-1]]

    @property
    def postings(self) -> dict[int, set[int]]:
        """pair -> numbers of the words that hold it."""
        out: dict[int, set[int]] = {}
        for k, word in enumerate(self.words):
            for a, b in zip(word, word[1:]):
                out.setdefault(pair(a, b), set()).add(k)
        return out


def _summed_pairs(pairs: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once with its sum; pairs with the sum 0 are left out."""
    if not len(pairs):
        return pairs.astype(np.int64), numbers.astype(np.int64)
    order = np.argsort(pairs, kind="stable")
    p = pairs[order]
    starts = np.flatnonzero(np.diff(p, prepend=p[0] - 1))
    n = np.add.reduceat(numbers[order], starts)
    return p[starts][n != 0], n[n != 0]


#: What a Python worker keeps from round to round: (training, chunk) -> Chunk, least recently used first.
_KEPT: OrderedDict[tuple[str, int], Chunk] = OrderedDict()


def chunk_at(training: str, number: int, row: tuple[bytes, bytes, bytes], log: list[Round]) -> Chunk:
    """The chunk after all rounds of ``log``, caught up or rebuilt."""
    key = (training, number)
    chunk = _KEPT.pop(key, None)
    if chunk is None or chunk.applied > len(log):
        chunk = Chunk(*row)
    while chunk.applied < len(log):
        chunk.apply(log[chunk.applied], chunk.applied == len(log) - 1)
    for old in [k for k in _KEPT if k[0] != training]:
        del _KEPT[old]
    _KEPT[key] = chunk
    while len(_KEPT) > 1 and sum(c.symbols for c in _KEPT.values()) > KEPT_SYMBOLS:
        _KEPT.popitem(last=False)
    return chunk


def store_chunks(state: DataFrame, words_per_chunk: int) -> DataFrame:
    """(chunk, symbols, lengths, counts): one stored row per chunk from rows (w array<int>, n long)."""
    size = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("w").cast("long")).alias("s")).first()
    parts = max(1, -(-size["n"] // words_per_chunk), -(-(size["s"] or 0) // CHUNK_SYMBOLS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        symbols, lengths, counts = [], [], []
        for b in batches:
            w = b.column("w")
            symbols.append(w.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes())
            lengths.append(np.diff(np.asarray(w.offsets)).astype("<i4").tobytes())
            counts.append(b.column("n").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        row = [[TaskContext.get().partitionId()], *[[b"".join(x)] for x in (symbols, lengths, counts)]]
        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *[pa.array(x, pa.binary()) for x in row[1:]]],
                                         names=["chunk", "symbols", "lengths", "counts"])

    dealt = state.select("w", "n").repartition(parts, F.xxhash64("w"))
    return cut_lineage(dealt.mapInArrow(pack, "chunk int, symbols binary, lengths binary, counts binary"))


class Chunks:
    """The stored chunks and the log of what was merged."""

    def __init__(self, state: DataFrame, words_per_chunk: int):
        self.stored, self.log, self.training = store_chunks(state, words_per_chunk), [], uuid.uuid4().hex

    def _summed(self, what) -> DataFrame:
        """(pair, n) over all chunks; ``what(chunk)`` gives both as arrays and the words it touched, as pair -1."""
        training, log = self.training, self.log

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    (pairs, n), touched = what(chunk_at(training, r["chunk"], (r["symbols"], r["lengths"], r["counts"]), log))
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(pairs, -1), pa.int64()), pa.array(np.append(n, touched), pa.int64())],
                                                     names=["pair", "n"])

        return self.stored.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))

    def merge(self, merges: Round) -> tuple[dict[int, int], int]:
        """(how the pair counts changed, words touched) of one more round."""
        self.log.append(merges)
        found = self._summed(lambda c: (c.changed, c.touched)).toArrow()
        change = dict(zip(found.column("pair").to_pylist(), found.column("n").to_pylist()))
        return change, change.pop(-1, 0)

    def most_frequent(self, size: int) -> tuple[dict[int, int], tuple[int, int] | None]:
        """The counts of the ``size`` most frequent pairs, and (-count, pair) of the next one (None: there is none)."""
        rows = self._summed(lambda c: (c.pair_totals(), 0)).where("pair >= 0 and n > 0").orderBy(F.desc("n"), "pair").limit(size + 1).toArrow()
        pairs, n = rows.column("pair").to_pylist(), rows.column("n").to_pylist()
        return dict(zip(pairs[:size], n[:size])), (-n[size], pairs[size]) if len(pairs) > size else None


class Head:
    """Counts of the most frequent pairs, most frequent first, ties by the smaller pair."""

    def __init__(self, chunks: Chunks, size: int = HEAD):
        self.chunks, self.size, self.reads = chunks, size, 0
        self.read()

    def read(self) -> None:
        self.counts, self.floor = self.chunks.most_frequent(self.size)
        self.order = [(-n, p) for p, n in self.counts.items()]
        heapq.heapify(self.order)
        self.reads += 1

    def first(self) -> tuple[int, int] | None:
        """(count, pair) of the most frequent pair; None if there is none or one outside may come before it."""
        while self.order:
            n, p = self.order[0]
            now = self.counts.get(p, 0)
            if now == -n:
                return (now, p) if self.floor is None or (n, p) < self.floor else None
            heapq.heappop(self.order)  # its count has changed: back with the present one
            if now:
                heapq.heappush(self.order, (-now, p))
        return None

    def change(self, changes: dict[int, int], again: set[int], merged: Round) -> None:
        """Add a round's changes; ``again`` holds tokens that were made before this round."""
        if self.floor and again:
            return self.read()  # pairs outside may have risen
        new = set(merged.values())
        for p, d in changes.items():
            if p in self.counts or self.floor is None or p >> _SHIFT in new or p & (1 << _SHIFT) - 1 in new:
                n = self.counts.get(p, 0) + d
                if n > 0:
                    self.counts[p] = n
                    if d > 0 or p in merged:
                        heapq.heappush(self.order, (-n, p))
                else:
                    self.counts.pop(p, None)
        if len(self.counts) > 2 * self.size:
            self.read()


def merge_rounds(state: DataFrame, vocab: list[str], ids: dict[str, int], vocab_size: int, min_frequency: int, top_k: int,
                 words_per_chunk: int, stats: dict | None, head: int = HEAD) -> list[tuple[int, str, str]]:
    """Merges (rank, left, right) until the vocabulary is full or no pair is frequent enough; ``vocab`` and ``ids`` grow.

    A round takes the longest prefix of the ranked pairs whose counts no earlier
    merge of the round can have changed.  Merging (a, b) changes the counts of
    pairs ending in a and of pairs starting with b; pairs with the new token are
    no more frequent than those, and lose ties to them.  A round also ends after
    a pair of equals, whose new pair of pairs may be as frequent as what
    follows, and after a merge that makes a token again, since ties go to the
    smaller token.
    """
    chunks = Chunks(state, words_per_chunk)
    counts = Head(chunks, head)
    merges: list[tuple[int, str, str]] = []
    touched = []
    while len(vocab) < vocab_size:
        ends_in: set[int] = set()
        starts_with: set[int] = set()
        accepted: Round = {}
        again: set[int] = set()
        while len(vocab) < vocab_size and len(accepted) < top_k:
            best = counts.first()
            if best is None and not accepted and counts.floor:
                counts.read()
                best = counts.first()
            if best is None or best[0] < min_frequency:
                break
            a, b = best[1] >> _SHIFT, best[1] & (1 << _SHIFT) - 1
            if b in ends_in or a in starts_with:
                break
            token = vocab[a] + vocab[b]
            made = token in ids
            if not made:
                ids[token] = len(vocab)
                vocab.append(token)
            else:
                again.add(ids[token])
            heapq.heappop(counts.order)
            accepted[best[1]] = ids[token]
            merges.append((len(merges), vocab[a], vocab[b]))
            ends_in.add(a)
            starts_with.add(b)
            if made or a == b:
                break
        if not accepted:
            break
        changes, words = chunks.merge(accepted)
        touched.append(words)
        counts.change(changes, again, accepted)
    if stats is not None:
        stats.update(rounds=len(touched), touched=touched, reads=counts.reads)
    return merges
