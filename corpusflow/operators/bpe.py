"""Byte-level BPE tokenizer trained and applied as Spark jobs.

Pipeline per text line (the trainer reads its corpus file line by line, line
endings kept): NFKC normalise (F12, Arrow UDF - Spark has no NFKC) -> prefix a
space unless the line starts with one -> split with the GPT-2 pattern ->
map every UTF-8 byte to its printable stand-in character (JVM expressions:
``hex(encode(...))`` and a 256-entry lookup) -> distinct words with counts (A10).

Training (B1) works on the distinct-word table, never on the corpus, in rounds
of several merges that give exactly the result of one merge at a time
(``bpe_rounds``): a round rewrites only the words that hold a merged pair.

Encoding (B2) runs the merges by rank on each word of a text, through a bounded
cache of words (Arrow UDF with the merge table, which is bounded by the
vocabulary size); decoding (B3) maps ids to tokens and bytes back to text.
Both are narrow: no word or id is shuffled.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.operators.bpe_rounds import merge_rounds
from corpusflow.session import cut_lineage

# fixed values of the tokenizer trainer
SPECIAL_TOKENS = ["<|endoftext|>", "<|padding|>"]
VOCAB_SIZE = 5000
MIN_FREQUENCY = 2
# fixed: the GPT-2 pre-tokenisation pattern ((?U): Unicode \s as in the original)
PRETOKEN_RE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """Printable stand-in character for every byte value (rule: printable Latin-1 bytes map to
    themselves, the other bytes to 256, 257, ... in byte order)."""
    keep = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) \
        | set(range(ord("®"), ord("ÿ") + 1))
    out, extra = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


_ALPHABET = byte_alphabet()
_BYTE_OF = {c: i for i, c in enumerate(_ALPHABET)}
_LATIN1 = "".join(chr(b) for b in range(256))
_ALPHABET_STR = "".join(_ALPHABET)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC normalisation, one Arrow batch at a time."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def pretokenize(text: str | Column, add_prefix_space: bool = True) -> Column:
    """Pieces of a (normalised) line in the byte-level alphabet."""
    t = F.col(text) if isinstance(text, str) else text
    if add_prefix_space:
        t = F.when(F.startswith(t, F.lit(" ")), t).otherwise(F.concat(F.lit(" "), t))
    pieces = F.regexp_extract_all(t, F.lit(PRETOKEN_RE), 0)
    # bytes -> one Latin-1 char each -> the byte-level stand-in character (both JVM built-ins)
    return F.transform(pieces, lambda p: F.translate(F.decode(F.encode(p, "UTF-8"), "ISO-8859-1"),
                                                     _LATIN1, _ALPHABET_STR))


def corpus_sequences(lines: DataFrame, col: str = "value", line_ending: str = "\n") -> DataFrame:
    """Lines as the trainer reads a text file: records are split at every newline, each line keeps its
    ending, and each record, written with a blank-line separator, adds one more line holding just the ending."""
    own = F.transform(F.split(F.col(col), "\n", -1), lambda x: F.concat(x, F.lit(line_ending)))
    return lines.select(F.explode(F.concat(own, F.array(F.lit(line_ending)))).alias("line"))


def word_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    """A10: ``word`` (byte-level piece), ``n`` over all lines; a partial aggregation."""
    pieces = lines.select(F.explode(pretokenize(nfkc(F.col(col)))).alias("word"))
    return pieces.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent symbol pairs of the byte-level words, weighted by word count: ``left, right, n``."""
    chars = F.split("word", "")
    pairs = F.transform(F.sequence(F.lit(0), F.size(chars) - 2),
                        lambda i: F.struct(F.get(chars, i).alias("l"), F.get(chars, i + 1).alias("r")))
    return (words.where(F.length("word") >= 2).select(F.explode(pairs).alias("p"), "n")
            .groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("n")))


def train_bpe(words: DataFrame, vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY,
              special_tokens=tuple(SPECIAL_TOKENS), top_k: int = 256, words_per_partition: int = 50_000,
              stats: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """B1: ``(vocab(id, token), merges(rank, left, right))`` from ``word, n`` rows.

    ``top_k`` bounds how many merges a round may take and changes no result;
    the word table is dealt out in chunks of ``words_per_partition`` words.
    ``stats`` (optional dict) receives the number of rounds, the words touched
    in each, and how often the pair counts were read in full.
    """
    spark = words.sparkSession
    words = cut_lineage(words)  # the corpus is read and cut once
    vocab: list[str] = list(special_tokens)
    ids: dict[str, int] = {t: i for i, t in enumerate(vocab)}
    # initial alphabet: characters seen, in code point order (at most 256 in byte-level form)
    chars = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c"))
                   .where(F.col("c") != "").distinct().collect())
    for c in chars:
        if len(vocab) >= vocab_size:
            break
        if c not in ids:
            ids[c] = len(vocab)
            vocab.append(c)
    by_point = [None] * (max(map(ord, chars), default=0) + 1)
    for c in chars:
        by_point[ord(c)] = ids.get(c)
    char_ids = F.lit([-1 if x is None else x for x in by_point])
    state = words.select(F.transform(F.split("word", ""), lambda c: F.nullif(F.get(char_ids, F.ascii(c)), F.lit(-1))).alias("w"),
                         F.col("n").cast("long").alias("n")).where(F.length("word") > 0)
    state = cut_lineage(state.where(~F.exists("w", lambda x: x.isNull())))
    merges = merge_rounds(state, vocab, ids, vocab_size, min_frequency, top_k, words_per_partition, stats)
    vocab_df = spark.createDataFrame(list(enumerate(vocab)), "id long, token string")
    merges_df = spark.createDataFrame(merges, "rank long, left string, right string")
    return vocab_df, merges_df


def _ranked(vocab: DataFrame, merges: DataFrame) -> tuple[dict[str, int], dict[tuple[int, int], tuple[int, int]]]:
    """Token -> id, and pair of ids -> (rank, id of what they make); bounded by the vocabulary size."""
    ids = {r["token"]: int(r["id"]) for r in vocab.collect()}
    return ids, {(ids[r["left"]], ids[r["right"]]): (int(r["rank"]), ids[r["left"] + r["right"]]) for r in merges.collect()}


def encode_word(word: str, ids: dict[str, int], ranked: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """B2: merges by rank, leftmost first, in n log n: pairs wait in a heap, symbols are a linked list.

    Characters that the vocabulary lacks stay unmerged and are left out.
    """
    token = [ids.get(c, -1) for c in word]
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = []
    for k in range(n - 1):
        m = ranked.get((token[k], token[k + 1]))
        if m is not None:
            waiting.append((m[0], k, token[k], token[k + 1]))
    heapify(waiting)
    gone = [False] * n
    while waiting:
        _, k, a, b = heappop(waiting)
        right = after[k]
        if gone[k] or right >= n or token[k] != a or token[right] != b:
            continue  # one of the two has been merged since
        token[k] = ranked[a, b][1]
        gone[right] = True
        after[k] = following = after[right]
        if following < n:
            before[following] = k
            m = ranked.get((token[k], token[following]))
            if m is not None:
                heappush(waiting, (m[0], k, token[k], token[following]))
        previous = before[k]
        if previous >= 0:
            m = ranked.get((token[previous], token[k]))
            if m is not None:
                heappush(waiting, (m[0], previous, token[previous], token[k]))
    return [t for t, out in zip(token, gone) if not out and t >= 0]


#: Words whose ids a task keeps, and the longest that is kept.
CACHED_WORDS, CACHED_CHARS = 200_000, 100


def _encoder(ids: dict, ranked: dict):
    """word -> ids through a bounded cache."""
    known: dict[str, list[int]] = {}

    def encode(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            found = encode_word(word, ids, ranked)
            if len(word) <= CACHED_CHARS:
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[word] = found
        return found

    return encode


def encode_words(words: DataFrame, vocab: DataFrame, merges: DataFrame, col: str = "word") -> DataFrame:
    """B2 on single words: ``word, ids array<bigint>``."""
    one = words.select(col, F.array(col).alias("_pieces"))
    return _encode_pieces(one, [col], vocab, merges)


def encode_texts(df: DataFrame, key_cols, text_col: str, vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """B2: ``key_cols, ids`` for every text (normalised, pre-tokenised, BPE per word); no shuffle, one row per row."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    return _encode_pieces(df.select(*key_cols, pretokenize(nfkc(whole)).alias("_pieces")), list(key_cols), vocab, merges)


def _encode_pieces(df: DataFrame, keys: list[str], vocab: DataFrame, merges: DataFrame) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(_ranked(vocab, merges))  # bounded by the vocabulary size

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(*shared.value)
        for pieces in batches:
            yield pieces.map(lambda p: [i for w in p for i in encode(w)])

    return df.select(*keys, enc(F.col("_pieces")).alias("ids"))


def decode_ids(df: DataFrame, ids_col: str, vocab: DataFrame, key_cols) -> DataFrame:
    """``key_cols, text``: ids -> tokens -> bytes -> UTF-8 text (JVM-side, one row per row).

    The tokens by id are one literal of the plan, bounded by the vocabulary
    size.  Special tokens and unknown ids give nothing; no ids give "".
    """
    tokens = {int(r["id"]): r["token"] for r in vocab.collect() if r["token"] not in SPECIAL_TOKENS}
    table = F.split(F.lit("\x01".join(tokens.get(k, "") for k in range(max(tokens, default=0) + 1))), "\x01", -1)
    pieces = F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<bigint>")), lambda i: F.coalesce(F.get(table, i.cast("int")), F.lit("")))
    latin1 = F.translate(F.array_join(pieces, ""), _ALPHABET_STR, _LATIN1)
    return df.select(*key_cols, F.decode(F.encode(latin1, "ISO-8859-1"), "UTF-8").alias("text"))
