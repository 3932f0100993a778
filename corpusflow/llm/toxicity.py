"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams of its lower-cased
whole text.  Each feature's value is its naive Bayes log-count ratio between
the classes, and a logistic regression is trained on these scaled features.
The ratio and the trained weight are multiplied into one number per bucket, so
scoring adds up one float per distinct n-gram.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, pick
from .training import labelled_sample

SIZES = (4, 5, 6)
BITS = 20
MAX_ROWS = 5_000
MAX_BYTES = 48_000_000


def ngram_buckets(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash of every character n-gram of the lower-cased text, with repeats."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, h = [], points * np.uint32(0x9E3779B1)
    for n in range(2, max(sizes) + 1):
        if len(points) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1:] * np.uint32(0x9E3779B1)
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Distinct:
    """Distinct bucket numbers of one text in time linear in it; keeps a table of one place per bucket."""

    def __init__(self, bits: int):
        self.mark = np.zeros(1 << bits, np.int32)

    def __call__(self, buckets: np.ndarray) -> np.ndarray:
        at = np.arange(len(buckets), dtype=np.int32)
        self.mark[buckets] = at  # the last writer of each bucket stays
        return buckets[self.mark[buckets] == at]


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, by bucket
    sizes: tuple[int, ...]
    bits: int


def fit(rows: list[tuple[str, int]], *, sizes: tuple[int, ...] = SIZES, bits: int = BITS, least: int = 3,
        sure: float = 4.0, steps: int = 80, l2: float = 0.3, smooth: float = 1.0,
        rate: float = 0.05) -> Model:
    """Fit on (text, label) rows.

    Features seen in fewer than ``least`` texts, or whose log ratio is within
    ``sure`` standard errors of zero, get none.  Without rows of both classes the score is the smoothed share of label 1."""
    distinct, width = Distinct(bits), 1 << bits
    y = np.array([c for _, c in rows], np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    none = Model(float(np.log(share / (1 - share))), np.zeros(width, np.float32), sizes, bits)
    if not len(y) or y.min() == y.max():
        return none
    p, q = np.zeros(width), np.zeros(width)
    for t, c in rows:  # features are made twice, so that only those in use are held
        (p if c else q)[distinct(ngram_buckets(t, sizes, bits))] += 1
    # share of a class's documents that hold the feature
    ratio = np.log((p + smooth) / (y.sum() + 2 * smooth)) - np.log((q + smooth) / (len(y) - y.sum() + 2 * smooth))
    error = np.sqrt(1 / (p + smooth) + 1 / (q + smooth))  # standard error of the log ratio
    ratio[(p + q < least) | (np.abs(ratio) < sure * error)] = 0.0
    used = ratio != 0
    sets = []
    for t, _ in rows:
        own = distinct(ngram_buckets(t, sizes, bits))
        sets.append(own[used[own]])
    flat = np.concatenate(sets).astype(np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = ratio[flat].astype(np.float32)
    w, b = np.zeros(width, np.float32), float(np.log(share / (1 - share)))
    m, v = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=value * w[flat], minlength=len(sets)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32)
        g = np.bincount(flat, weights=value * err[owner], minlength=width).astype(np.float32)
        g = np.append(g + l2 * w, err.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g  # Adam
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(b, (w * ratio).astype(np.float32), sizes, bits)


def scorer(model: Model) -> Callable[[str], tuple[float]]:
    distinct: list[Distinct] = []

    def score(text: str) -> tuple[float]:
        if not distinct:
            distinct.append(Distinct(model.bits))
        own = distinct[0](ngram_buckets(text, model.sizes, model.bits))
        z = model.bias + float(model.weights[own].sum(dtype=np.float64))
        return (float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))),)

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", modulus: int = 5, remainder: int = 0, cut: float = 0.5,
                    max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 if score >= ``cut``).

    Every whole text is scored, and only the text goes into a score.  Labels are
    learnt from rows that are not held out, on a bounded sample of at most
    ``max_rows`` rows and ``max_bytes`` bytes (see ``labelled_sample``).  Null
    text counts as empty and gets the bias alone; null ids pass through;
    repeated rows score alike; without labels of both classes every score is
    the smoothed share of label 1.  Empty documents give an empty result.
    """
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col,
                           exclude=held_out(F.col("id"), modulus, remainder), max_rows=max_rows, max_bytes=max_bytes)
    return apply_model(docs, fit(rows), held_out(F.col("id"), modulus, remainder), cut, id_col, text_col)


def apply_model(docs: DataFrame, model: Model, held: Column, cut: float, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket
    cache: list[Callable] = []

    def row(text: str) -> tuple[float]:
        if not cache:
            cache.append(scorer(shared.value))
        return cache[0](text)

    scored = map_texts(pick(docs, id=id_col, text=text_col), "score double", row, "id")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
