"""Best-fit packing of token sequences by bin completion.

Only the number of pieces of each length matters for the packing, and lengths
are at most the capacity, so the plan is made on a table of at most
``capacity`` counters, however many documents there are.  Bin completion takes
the longest piece that is left and enumerates all undominated fillings of the
space beside it; a filling is dominated if a piece outside it could take the
place of some of its pieces without a loss.  A filling is used as often as the
counters allow, and less often later.  The search is depth-first with the least
waste first; a branch ends when its waste, or the lower bound of what is left,
cannot beat the incumbent, which is the best of some best-fit solutions until a
better one is found.  There is no search at all where that meets the bound.  Fillings are made
as they are needed, so the number of steps is the only bound of the search.

Pieces then find their places: each has a rank among the pieces of its length
(numbered per partition, then shifted by partition totals), and the plan maps
ranks to sequences.  No piece, text or id list passes through the driver.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpoint, from_file_bytes, kept, pick, slices

CAPACITY = 4096
END_ID = 1
#: Steps (fillings looked at) that the branch and bound may take; the incumbent stands when they are used up.
STEPS = 6000
#: Splits of the lengths that are tried for a first solution, and steps of the bound that is taken at every node.
SPLITS, BOUND_FOLDS = 16, range(1, 6)
#: Entries of a worker's two caches (some 200 bytes each).
CACHE_CHUNKS, CACHE_PARTS = 40_000, 400_000
CACHED_CHARS = 200


# --- tokens -------------------------------------------------------------------------------------

class _Cache(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes, by ``tokenizer``; long words are not kept.

    A full table becomes the old one and a new one begins; words that the old one
    has move over as they are met, so frequent words stay.
    """

    def __init__(self, tokenizer, size: int):
        super().__init__({"": b""})
        self.tokenizer, self.size, self.old = tokenizer, size // 2, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes, through bounded caches.

    For tokenizers that lower case and cut words, digits and punctuation apart
    before encoding, so that a text's ids are those of its parts in order.
    Texts in Latin-1 (without the mark that special tokens begin with) are
    lowered and cut here, which gives one cache entry per part; all others are
    cut at ASCII white space, and the tokenizer does the rest with each chunk.
    """

    LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    SPACE = "\t-\r \u0085\u00a0"
    #: Fixed by the tokenizer's file: contractions, words, single digits, anything else but white space.
    PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
    PROBE = "Don't STOP: " + " a".join(map(chr, range(1, 256))) + " x".join(map(chr, range(33, 256))) + "We'll're 12 ½."

    def __init__(self, path: str, chunks: int = CACHE_CHUNKS, parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.chunks = _Cache(tokenizer, chunks)
        # a part is in normal form and one pre-token: no normaliser, no split
        plain = Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.parts = _Cache(plain, parts)
        want = np.array(tokenizer.encode(self.PROBE, add_special_tokens=False).ids, "<u4").tobytes()
        self.cut = self._parts(self.PROBE) == want

    def _parts(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))

    def ids(self, text: str) -> bytes:
        if self.cut and "<|" not in text:
            try:
                text.encode("latin-1")
                return self._parts(text)
            except UnicodeEncodeError:
                pass
        for gap in "\n\t\r\x0b\x0c":
            text = text.replace(gap, " ")
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(map(self.ids, texts))


def worker_ids(key: tuple, shared, chunks: int = CACHE_CHUNKS, parts: int = CACHE_PARTS) -> WordIds:
    """The worker's encoder: its caches stay warm from task to task."""
    return kept((*key, chunks, parts), lambda: from_file_bytes(shared.value, lambda path: WordIds(path, chunks, parts)))


PIECES = ("id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, cached_parts: int = CACHE_PARTS) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, part, rank).

    ``part`` numbers the task and ``rank`` the pieces of this length in it, so
    the two must be stored together before use (a task that runs again writes
    all of its rows anew).  The tokenizer file is shipped to the workers.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    key, shared = ("ids", len(data), zlib.crc32(data)), spark.sparkContext.broadcast(data)  # a vocabulary file of a few MB
    schema = spark.createDataFrame([], PIECES.format(id=dict(docs.dtypes)["id"])).schema
    arrow = to_arrow_schema(schema)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = worker_ids(key, shared, parts=cached_parts)
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch, 4 << 20):
                cols: list[list] = [[], [], [], [], []]
                owners = []
                for k, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()])):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        length = len(cut) // 4
                        owners.append(k)
                        for col, x in zip(cols, (n, at // 4, length, zlib.crc32(cut), ranks[length])):
                            col.append(x)
                        ranks[length] += 1
                out = [some.column("id").take(pa.array(owners, pa.int64())), *[pa.array(c) for c in cols[:4]],
                       pa.array([part] * len(owners)), pa.array(cols[4])]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(out, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


# --- plan ---------------------------------------------------------------------------------------

@dataclass
class Use:
    """A sequence content (lengths, longest first) and how many sequences have it."""

    lengths: tuple[int, ...]
    times: int


def _largest(counts: np.ndarray) -> np.ndarray:
    """For each x the longest available length of at most x (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def best_fit(counts: np.ndarray, capacity: int) -> list[Use]:
    """Best-fit decreasing on counters: always the longest piece that fits the space left."""
    left, out = counts.copy(), []
    below = _largest(left)
    while below[-1]:
        lengths, space, used = [], capacity, np.zeros_like(left)
        while space:
            x = int(below[min(space, capacity)])
            while x and left[x] <= used[x]:
                x = int(below[x - 1])
            if not x:
                break
            lengths.append(x)
            used[x] += 1
            space -= x
        times = min(int(left[x] // used[x]) for x in set(lengths))
        for x in lengths:
            left[x] -= times
        below = _largest(left)
        out.append(Use(tuple(lengths), times))
    return out


def balanced(counts: np.ndarray, capacity: int, split: int) -> list[Use]:
    """Best fit for the longest piece while it is over ``split``; then as many pieces beside it as can be.

    Those are the shortest ones but for the last, which is the longest that
    still fits, so that a sequence holds long, short and middling pieces.
    """
    left, out = counts.copy(), []
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        left[longest] -= 1
        space = capacity - longest
        if longest > split:
            rest = _greedy(left, space)
        else:
            lengths = np.flatnonzero(left[:space + 1])
            ends = np.cumsum(left[lengths] * lengths)
            k = int(np.searchsorted(ends, space, side="right"))  # lengths of which all pieces fit
            short = [(int(x), int(left[x])) for x in lengths[:k]]
            room = space - (int(ends[k - 1]) if k else 0)
            if k < len(lengths):
                short.append((int(lengths[k]), room // int(lengths[k])))
            pieces = [x for x, n in short for _ in range(n)]
            if pieces:
                pieces.pop()
                below = left[:space - sum(pieces) + 1].copy()
                for x in pieces:
                    if x < len(below):
                        below[x] -= 1
                pieces.append(int(np.flatnonzero(below > 0)[-1]))
            rest = tuple(sorted(pieces, reverse=True))
        left[longest] += 1
        content = (longest, *rest)
        times = min(int(left[x]) // content.count(x) for x in set(content))
        for x in content:
            left[x] -= times
        out.append(Use(content, times))
    return out


def incumbents(counts: np.ndarray, capacity: int) -> Iterator[list[Use]]:
    """Best-fit decreasing, then ``balanced`` at splits over the lengths, finer around the best of them."""
    yield best_fit(counts, capacity)
    lengths = np.flatnonzero(counts)  # all of them: each round below tries some SPLITS, however many there are
    tried: dict[int, int] = {}
    a, b = 0, len(lengths) - 1
    while b >= a:
        step = max(1, (b - a) // SPLITS)
        for k in range(a, b + 1, step):
            if k not in tried:
                found = balanced(counts, capacity, int(lengths[k]))
                tried[k] = sum(u.times for u in found)
                yield found
        best = min(range(a, b + 1, step), key=lambda k: tried[k])
        if step == 1:
            return
        a, b = max(a, best - step), min(b, best + step)


def lower_bound(counts: np.ndarray, capacity: int, folds: range = range(1, 31)) -> int:
    """Sequences that any packing needs: the largest of bounds by dual feasible functions.

    Pieces longer than capacity - t count as whole sequences and those shorter
    than t as nothing, for every t up to half the capacity; the others count
    with their share of the capacity, or with that share rounded down to steps
    of 1/k after growing by one part in k (which never lets a sequence hold
    more than one).
    """
    x = np.arange(capacity + 1)
    number = np.zeros(capacity + 1, np.int64)
    number[:len(counts)] = counts
    t = np.arange(capacity // 2 + 1)
    whole = np.concatenate(([0], np.cumsum(number[::-1])))[t]  # pieces over capacity - t
    best = int(number[capacity // 2 + 1:].sum())
    for k in (0, *folds):
        if k:
            grown = (k + 1) * x
            value, unit = np.where(grown % capacity == 0, k * x, grown // capacity * capacity), k * capacity
        else:
            value, unit = x, capacity
        sums = np.concatenate(([0], np.cumsum(number * value)))
        middle = sums[capacity - t + 1] - sums[t]
        best = max(best, int((whole + -(-middle // unit)).max()))
    return best


def _greedy(counts: np.ndarray, space: int) -> tuple[int, ...]:
    """Always the longest piece that fits the space left: of all fillings the first by length, so none dominates it."""
    below, out = _largest(counts), []
    while space:
        x = int(below[space])
        while x and counts[x] <= out.count(x):
            x = int(below[x - 1])
        if not x:
            break
        out.append(x)
        space -= x
    return tuple(out)


def _reachable(lengths: list[int], counts: list[int], space: int) -> list[int]:
    """Bit s of entry k is 1 if pieces of the k shortest lengths have the sum s."""
    full = (1 << space + 1) - 1
    sums, out = 1, [1]
    for x, n in zip(lengths, counts):
        n, part = min(n, space // x), 1
        while n and sums != full:
            part = min(part, n)
            sums |= sums << part * x & full
            n, part = n - part, 2 * part
        out.append(sums)
    return out


def _exact(lengths: list[int], counts: list[int], reach: list[int], end: int, total: int) -> Iterator[tuple[int, ...]]:
    """Every choice among the pieces of the ``end`` shortest lengths with the sum ``total``, longest pieces first."""
    if not total:
        yield ()
        return
    for j in range(bisect_right(lengths, total, 0, end) - 1, -1, -1):
        if not reach[j + 1] >> total & 1:
            return
        x = lengths[j]
        for k in range(min(counts[j], total // x), 0, -1):
            if reach[j] >> total - k * x & 1:
                for more in _exact(lengths, counts, reach, j, total - k * x):
                    yield (x,) * k + more


def _dominated(filling: tuple[int, ...], waste: int, unused: int) -> bool:
    """Whether a piece that is not in the filling (bits of ``unused``) fits in place of some of it and loses nothing.

    It does if it is longer than what it replaces, or as long as several pieces.
    """
    one, more = 0, 0  # sums of one piece, of several
    for x in filling:
        more |= more << x | one << x
        one |= 1 << x
    if unused & more:
        return True
    sums, wide = one | more | 1, 0
    while wide < waste:  # up to ``waste`` above a sum
        step = min(wide + 1, waste - wide)
        sums |= sums << step
        wide += step
    return bool(unused & sums & ~(one | more | 1))


def fillings(left: np.ndarray, longest: int, space: int, most: Callable[[], int]) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``space`` beside a piece ``longest`` out of ``left``, least waste first.

    They are made one by one, None standing for one that is dominated; ``most``
    tells the waste that is still of use.  Only a single piece that fills the
    space dominates all others.  ``left`` must be as it was whenever the next
    one is asked for.
    """
    def rest() -> np.ndarray:
        counts = left.copy()
        counts[longest] -= 1
        return counts

    first = _greedy(rest(), space)
    full = sum(first) == space
    if full or not first:
        yield first
        if len(first) < 2:
            return
    counts = rest()[:space + 1]
    lengths = np.flatnonzero(counts).tolist()
    counts = counts[lengths].tolist()
    reach = _reachable(lengths, counts, space)
    number = dict(zip(lengths, counts))
    present = sum(1 << x for x in lengths)
    waste = 0
    while waste < space and waste <= most():
        if reach[-1] >> space - waste & 1:
            for found in _exact(lengths, counts, reach, len(lengths), space - waste):
                if full and found == first:
                    continue
                unused = present
                for x in set(found):
                    if number[x] == found.count(x):
                        unused ^= 1 << x
                yield None if _dominated(found, waste, unused) else found
        waste += 1


def plan(counts: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[Use]:
    """Sequences that hold ``counts[x]`` pieces of each length x, by branch and bound over bin completions."""
    total = int((np.arange(len(counts)) * counts).sum())
    if not total:
        return []
    least, incumbent, bins = lower_bound(counts, capacity), [], 0
    for found in incumbents(counts, capacity):
        n = sum(u.times for u in found)
        if not incumbent or n < bins:
            incumbent, bins = found, n
        if bins == least:
            return incumbent
    # depth-first on one table of counters, which is put back when a choice is given up
    left, uses, n, waste = counts.copy(), [], 0, 0
    seen: dict[bytes, int] = {}  # counters left -> fewest sequences they were reached with

    def most() -> int:
        return (bins - 1) * capacity - total - waste

    def choices() -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Each filling as often as the counters allow, then each less often; None: a step without a choice."""
        longest = int(np.flatnonzero(left)[-1])
        space = capacity - longest
        for fewer in (False, True):
            for filling in fillings(left, longest, space, most):
                if filling is None or fewer:
                    yield None
                if filling is not None:
                    content = (longest, *filling)
                    times = min(int(left[x]) // content.count(x) for x in set(content))
                    for k in range(times - 1, 0, -1) if fewer else (times,):
                        yield content, k
                    if not fewer and filling == (space,):
                        return

    def use(content: tuple[int, ...], times: int) -> None:
        nonlocal n, waste
        for x in content:
            left[x] -= times
        n += times
        waste += (capacity - sum(content)) * times

    stack = [choices()]
    while stack and steps > 0 and bins > least:
        choice = next(stack[-1], ())
        if choice == ():  # all tried
            stack.pop()
            if uses:
                last = uses.pop()
                use(last.lengths, -last.times)
            continue
        steps -= 1
        if choice is None or (capacity - sum(choice[0])) * choice[1] > most():
            continue
        use(*choice)
        if not left.any():
            bins, incumbent = n, [*uses, Use(*choice)]
        elif n + lower_bound(left, capacity, BOUND_FOLDS) >= bins:
            pass  # what is left needs too many
        elif seen.get(key := blake2b(left.tobytes(), digest_size=16).digest(), n + 1) > n:
            seen[key] = n
            uses.append(Use(*choice))
            stack.append(choices())
            continue
        use(choice[0], -choice[1])
    return incumbent


# --- places -------------------------------------------------------------------------------------

def slots(uses: list[Use]) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset), ranks in order within each length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for u in uses:
        offset = 0
        for x in u.lengths:
            rows.append((x, used.get(x, 0), u.times, sequence, offset))
            used[x] = used.get(x, 0) + u.times
            offset += x
        sequence += u.times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, steps: int = STEPS, cached_parts: int = CACHE_PARTS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its text's ids and ``end_id``; only longer ones are cut
    into pieces of ``capacity`` ids.  Null and empty texts are the end id alone.
    Null ids pass through; repeated rows are packed each; an empty table gives
    an empty result.  ``cached_parts`` bounds a worker's cache and changes no result.
    """
    pieces = checkpoint(token_pieces(pick(docs, id=id_col, text=text_col), tokenizer_path, capacity, end_id, cached_parts))
    by_part = checkpoint(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    table = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, capacity, steps)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(shifted, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    out = f"id {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        starts = rows[:, 0] << 44 | rows[:, 1]  # fewer than 2^44 pieces of a length
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(starts, length << 44 | rank, side="right") - 1
            arrays = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(rows[k, 3] + rank - rows[k, 1]), pa.array(rows[k, 4])]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return ranked.mapInArrow(place, out).withColumnRenamed("id", id_col)
