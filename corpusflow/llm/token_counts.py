"""Token counts under edits: pre-token trees, re-encoding only what an edit touches.

A document is cut into pre-tokens, which are encoded one by one, so its count is
the sum over them.  Leaves of the tree are runs of pre-tokens with their lengths
and counts; inner nodes hold sums of characters and tokens.  An edit finds its
place by descending the tree, re-cuts from a few characters before it (the
pattern looks at most two characters past a pre-token) until a cut falls on an
old one in the text behind it, replaces the pre-tokens between and updates the
sums above.  Everything else keeps its counts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpoint, from_file_bytes, kept, pick, slices, small

RUN = 64  # pre-tokens a leaf holds when it is made; a leaf of twice as many is split
#: Rows of one id whose trees a task holds (about: an id with more is dealt out by chance), and ids with more that are broadcast.
ROWS, BROADCAST_ROWS = 32, 1_000_000
CACHE = 400_000
CACHED_CHARS = 200


class PieceCounter:
    """Pre-token -> number of tokens, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        missing = list(set(pieces).difference(self.known))
        if len(self.known) + len(missing) > CACHE:
            self.known, missing = {}, list(set(pieces))
        extra: dict[str, int] = {}
        for at in range(0, len(missing), 5000):
            part = missing[at:at + 5000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                (self.known if len(word) <= CACHED_CHARS else extra)[word] = len(e)
        known = {**self.known, **extra} if extra else self.known
        return list(map(known.__getitem__, pieces))


class TokenTree:
    """Sums of characters and tokens over runs of pre-tokens; node k has children 2k and 2k + 1.

    Half of the leaves are left empty when the tree is made, evenly spread, so
    that a run can be split next to where it stands: the runs of the smallest
    subtree with room are then spread anew, and sums change in it and above.
    """

    def __init__(self, text: str, counter: PieceCounter):
        self.text, self.counter = text, counter
        pieces = counter.cut.findall(text)
        sizes, counts = list(map(len, pieces)), counter.counts(pieces)
        self.recut = len(text)  # characters cut and encoded so far
        self.summed = 0  # nodes whose sums were made
        self._build([(sizes[k:k + RUN], counts[k:k + RUN]) for k in range(0, len(sizes), RUN)])

    def _build(self, runs: list[tuple[list[int], list[int]]]) -> None:
        n = 1
        while n < 2 * len(runs):
            n *= 2
        self.width = n
        self.runs: list[tuple[list[int], list[int]]] = [([], [])] * n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        self._spread(0, n, runs)

    def _spread(self, begin: int, size: int, runs: list[tuple[list[int], list[int]]]) -> None:
        """Deal ``runs`` out evenly over ``size`` leaves and sum them up."""
        own: list[tuple[list[int], list[int]]] = [([], [])] * size
        for k, run in enumerate(runs):
            own[k * size // len(runs)] = run
        self.runs[begin:begin + size] = own
        self._sum(begin, begin + size - 1)

    def _sum(self, first: int, last: int) -> None:
        """The sums of leaves ``first`` to ``last`` and of what is above them."""
        a, b = first + self.width, last + self.width
        for k in range(a, b + 1):
            sizes, counts = self.runs[k - self.width]
            self.chars[k], self.tokens[k] = sum(sizes), sum(counts)
        self.summed += b - a + 1
        while a > 1:
            a, b = a // 2, b // 2
            for k in range(a, b + 1):
                self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
                self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.summed += b - a + 1

    def _replace(self, first: int, last: int, runs: list[tuple[list[int], list[int]]]) -> None:
        """Put ``runs`` in place of leaves ``first`` to ``last``."""
        if len(runs) <= last - first + 1:
            self.runs[first:last + 1] = runs + [([], [])] * (last - first + 1 - len(runs))
            return self._sum(first, last)
        size, level, levels = 1, 0, self.width.bit_length() - 1
        while size < self.width:
            size, level = 2 * size, level + 1
            begin = first // size * size
            if last >= begin + size:
                continue
            kept_before = [r for r in self.runs[begin:first] if r[0]]
            kept_after = [r for r in self.runs[last + 1:begin + size] if r[0]]
            n = len(kept_before) + len(runs) + len(kept_after)
            if n <= size * (1 - level / (2 * levels)):  # full at the leaves, half full at the root
                return self._spread(begin, size, kept_before + runs + kept_after)
        self._build([r for r in self.runs[:first] if r[0]] + runs + [r for r in self.runs[last + 1:] if r[0]])

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(run, index, start) of the pre-token that holds character ``at`` (the last one at the end)."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        run = node - self.width
        sizes = self.runs[run][0]
        for k, n in enumerate(sizes):
            if at < start + n or k == len(sizes) - 1:
                return run, k, start
            start += n
        return run, 0, start

    def edit(self, start: int, n_delete: int, insert: str) -> None:
        """Replace ``n_delete`` characters at ``start`` by ``insert``; a range outside the text is cut to it."""
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(start + max(n_delete, 0), len(old))
        self.text = old[:start] + insert + old[end:]
        shift = len(insert) - (end - start)
        # a pre-token may look two characters past its end, so cuts up to three characters back may move
        run, k, at = self._find(max(0, start - 3))
        first_run, first_k, begin = run, k, at
        pieces: list[str] = []
        new_at = begin
        sizes = self.runs[run][0]
        met = False
        for m in self.counter.cut.finditer(self.text, begin):
            while at < new_at - shift and not met:  # old cuts up to here
                if k < len(sizes):
                    at += sizes[k]
                    k += 1
                elif run + 1 < len(self.runs):
                    run, k = run + 1, 0
                    sizes = self.runs[run][0]
                else:
                    break
            if at == new_at - shift and at >= end and new_at >= start + len(insert):
                met = True
                break
            pieces.append(m.group())
            new_at = m.end()
        if not met:
            run, k = len(self.runs) - 1, len(self.runs[-1][0])
        self.recut += sum(map(len, pieces))
        counts = self.counter.counts(pieces)
        head, tail = self.runs[first_run], self.runs[run]
        merged = (head[0][:first_k] + list(map(len, pieces)) + tail[0][k:], head[1][:first_k] + counts + tail[1][k:])
        if len(merged[0]) <= 2 * RUN:
            parts = [merged] if merged[0] else []
        else:
            parts = [(merged[0][i:i + RUN], merged[1][i:i + RUN]) for i in range(0, len(merged[0]), RUN)]
        self._replace(first_run, run, parts)


def worker_counter(key: tuple, shared, pattern: str) -> PieceCounter:
    """The worker's counter: its cache stays warm from task to task."""
    return kept(key, lambda: from_file_bytes(shared.value, lambda path: PieceCounter(path, pattern)))


SCHEMA = ("id {id}, n_edits bigint, n_chars bigint, tokens_before bigint, n_tokens bigint, recut_chars bigint, "
          "run_chars array<int>, run_tokens array<int>")


def count_edited(docs: DataFrame, edits: DataFrame, tokenizer_path: str, pattern: str, *, id_col: str = "doc_id",
                 text_col: str = "text", seq_col: str = "seq", start_col: str = "start", delete_col: str = "n_delete",
                 insert_col: str = "insert") -> DataFrame:
    """One row per document after its edits: id, n_edits, n_chars, tokens before and after, recut_chars, tree leaves.

    Edits of a document apply in order of ``seq`` (ties: by their other columns),
    each to the text as the earlier ones left it; offsets are code points and
    are cut to the text.  Null texts and inserts count as empty, null offsets as
    0.  Edits without a document are dropped; documents without an id take no
    edits.  Rows that repeat an id are edited each.  An empty table of edits
    gives the plain counts, an empty table of documents an empty result.
    ``recut_chars`` counts the characters that edits made it cut and encode
    again; ``run_chars`` and ``run_tokens`` are the tree's leaves.

    Documents and edits meet by id in sorted order: a task holds the trees of
    one id and streams its edits.  The rows of an id that has more than
    ``ROWS`` are dealt out at random over as many groups as it takes, and its
    edits go to each of them.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    d = pick(docs, id=id_col, text=text_col)
    repeated = checkpoint(d.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS)
                          .select("id", F.ceil(F.col("n") / ROWS).cast("bigint").alias("groups")))
    repeated = small(repeated, BROADCAST_ROWS)  # an id and a number each
    e = pick(edits, id=id_col, seq=seq_col, start=start_col, n_delete=delete_col, text=insert_col).where("id is not null")
    none = F.lit(0).cast("bigint")
    number = F.xxhash64(F.monotonically_increasing_id())
    salt = F.when(F.col("id").isNull(), number).otherwise(F.pmod(number, F.coalesce("groups", F.lit(1).cast("bigint"))))
    salts = F.explode(F.sequence(none, F.coalesce("groups", F.lit(1).cast("bigint")) - 1)).alias("salt")
    rows = (d.join(repeated, "id", "left").select("id", salt.alias("salt"), F.lit(-1).cast("bigint").alias("seq"), none.alias("start"),
                                                  none.alias("n_delete"), "text", F.lit(False).alias("edit"))
            .unionByName(e.join(repeated, "id", "left").select(
                "id", salts, F.col("seq").cast("bigint"), F.col("start").cast("bigint"), F.col("n_delete").cast("bigint"), "text",
                F.lit(True).alias("edit"))))
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    key, shared = ("counts", pattern, len(data), zlib.crc32(data)), spark.sparkContext.broadcast(data)  # a vocabulary file of a few MB
    schema = spark.createDataFrame([], SCHEMA.format(id=kind)).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(key, shared, pattern)
        trees: list[list] = []  # [tree, tokens before, edits] of the rows of the current group
        current, group = None, None
        done: list[tuple] = []

        def close() -> None:
            for tree, before, n in trees:
                done.append((current, n, len(tree.text), before, tree.total, tree.recut,
                             [sum(s) for s, _ in tree.runs if s], [sum(c) for s, c in tree.runs if s]))
            trees.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], schema=arrow)
            done.clear()
            return out

        for batch in batches:
            for part in slices(batch, 4 << 20):
                for row in part.to_pylist():
                    if row["id"] is None or (row["id"], row["salt"]) != (current, group):
                        close()
                        current, group = row["id"], row["salt"]
                    if not row["edit"]:
                        tree = TokenTree(row["text"] or "", counter)
                        tree.recut = 0
                        trees.append([tree, tree.total, 0])
                        continue
                    for held in trees:
                        held[0].edit(row["start"] or 0, row["n_delete"] or 0, row["text"] or "")
                        held[2] += 1
                if len(done) >= 500:
                    yield flush()
        close()
        if done:
            yield flush()

    met = rows.repartition("id", "salt").sortWithinPartitions("id", "salt", "edit", "seq", "start", "n_delete", "text")
    return (met.select("id", "salt", "edit", "start", "n_delete", "text").mapInArrow(run, schema).withColumnRenamed("id", id_col))
