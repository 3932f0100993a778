"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)):
all pairwise interactions through vectors of rank ``RANK``, in time linear in
the number of features.  Features of a text:

* its distinct lower-cased words, hashed, each of value 1 / sqrt(number of them);
* structure statistics, each clipped and scaled by the training sample, and as
  the indicator of its training quantile, so that pairs of ranges interact;
* metadata known without a label: length in characters, words and lines.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, pick, positional, slices
from .training import labelled_sample

WORD_BITS = 16
RANK = 8
BINS = 10
MAX_ROWS = 6_000
MAX_BYTES = 48_000_000
CACHE = 150_000


def statistics(text: str, words: list[str], seen: Counter) -> list[float]:
    """Structure statistics and metadata of one text; zeros where there are no words."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = sum(map(text.count, "#*$%&|<>"))
    shouts = text.count("!") + text.count("?")
    upper = len(text) - len(text.translate(_NO_UPPER))
    digits = sum(map(text.count, "0123456789"))
    stops = text.count(".") + text.count(",") + text.count(";")
    same = sum(map(str.__eq__, words, words[1:]))
    top = max(seen.values(), default=0)
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), len(words) / max(1, len(lines)),
        (chars - text.count(" ")) / n, len(seen) / n, top / n, same / n, symbols / n, symbols / chars, shouts / n,
        upper / chars, digits / chars, stops / n, 1 - len(set(lines)) / max(1, len(lines)),
        (len(words) - sum(1 for c in seen.values() if c == 1)) / n,
    ]


_NO_UPPER = {k: None for k in range(65, 91)}
N_STATS = 16


class Features:
    """text -> (feature numbers, values); keeps a bounded cache of word hashes."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, edges: np.ndarray):
        self.mean, self.scale, self.edges, self.known = mean, scale, edges, {}

    def __call__(self, text: str, stats: list[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        seen = Counter(words)
        s = np.array(stats if stats is not None else statistics(text, words, seen))
        known = self.known
        if len(known) > CACHE:
            known.clear()
        hashed = []
        for w in seen:
            h = known.get(w)
            if h is None:
                h = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
            hashed.append(h)
        base = 1 << WORD_BITS
        bins = base + N_STATS + np.arange(N_STATS) * BINS + (s[:, None] > self.edges).sum(1)
        index = np.concatenate([np.array(hashed, np.int64), base + np.arange(N_STATS), bins])
        value = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))),
                                np.clip((s - self.mean) / self.scale, -4, 4) * 0.25, np.full(N_STATS, 0.5)])
        return index, value


N_FEATURES = (1 << WORD_BITS) + N_STATS + N_STATS * BINS


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray


def raw(model: Model, index: np.ndarray, value: np.ndarray) -> float:
    """The machine's output before the sigmoid, by the sum-of-squares identity."""
    vx = model.v[index] * value[:, None]
    total = vx.sum(0)
    return float(model.bias + model.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))


def fit(rows: list[tuple[str, int]], *, epochs: int = 6, rate: float = 0.05, l2: float = 1e-4, seed: int = 7) -> Model:
    """AdaGrad over single rows in seeded order.  Without rows of both classes only the bias is set."""
    texts, y = [t for t, _ in rows], np.array([c for _, c in rows], np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    stats = np.array([statistics(t, (w := t.lower().split()), Counter(w)) for t in texts]).reshape(-1, N_STATS)
    some = len(stats) > 0
    mean = stats.mean(0) if some else np.zeros(N_STATS)
    scale = np.maximum(stats.std(0), 1e-6) if some else np.ones(N_STATS)
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if some else np.zeros((N_STATS, BINS - 1))
    rng = np.random.default_rng(seed)
    m = Model(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)), mean, scale, edges)
    if not some or y.min() == y.max():
        return m
    m.v = rng.normal(0, 0.02, (N_FEATURES, RANK))
    make = Features(mean, scale, edges)
    feats = [make(t, list(s)) for t, s in zip(texts, stats)]
    gw, gv = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, RANK), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(len(feats)):
            index, value = feats[k]
            x = value[:, None]
            vi = m.v[index]
            vx = vi * x
            total = vx.sum(0)
            z = m.bias + m.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum())
            err = 1 / (1 + np.exp(-min(max(z, -30.0), 30.0))) - y[k]
            dw = err * value + l2 * m.w[index]
            dv = err * x * (total - vx) + l2 * vi
            gw[index] += dw * dw
            gv[index] += dv * dv
            m.bias -= 0.01 * err
            m.w[index] -= rate * dw / np.sqrt(gw[index])
            m.v[index] -= rate * dv / np.sqrt(gv[index])
    return m


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", modulus: int = 4, remainder: int = 2, max_rows: int = MAX_ROWS,
          max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (see ``labelled_sample``)."""
    rows = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col,
                           exclude=held_out(F.col("id"), modulus, remainder), max_rows=max_rows, max_bytes=max_bytes)
    model = fit(rows)
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


class Scorer:
    """text -> score; ships the model once per worker as a broadcast of 2.4 MB."""

    def __init__(self, docs: DataFrame, model: Model):
        self.shared, self.make = docs.sparkSession.sparkContext.broadcast(model), None

    def __call__(self, text: str) -> float:
        model = self.shared.value
        if self.make is None:
            self.make = Features(model.mean, model.scale, model.edges)
        z = raw(model, *self.make(text))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    modulus: int = 4, remainder: int = 2, cut: float = 0.7, **options) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1) and predicted (1 if score >= ``cut``).

    Every whole text is scored; labels, language, source and id are no inputs.
    Labels are learnt on a bounded sample of rows that are not held out (see
    ``train``).  Null text counts as empty; null ids pass through; repeated rows
    score alike; without labels of both classes every score is the smoothed
    share of label 1.  Empty documents give an empty result.
    """
    score = Scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col, modulus=modulus, remainder=remainder, **options))
    scored = map_texts(pick(docs, id=id_col, text=text_col), "score double", lambda t: (score(t),), "id")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7,
              **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``cut``.

    Null text counts as empty; rows with a null id are judged like any other;
    repeated rows stay or go together; an empty table gives an empty result.
    Without training labels of both classes there is nothing to judge by, and
    all rows stay.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    if not model.v.any():
        return docs
    score = Scorer(docs, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                yield part.filter(pa.array([score(t or "") >= cut for t in texts], pa.bool_()))

    plain = positional(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
