"""License scans: ordered signature rules behind a keyword prefilter, with priorities and containment.

Signatures (``license_rules``) are hand-written regular expressions over the
lower-cased text: tags, sentences of the legal texts, addresses, notices,
titles and fields.  One Aho-Corasick pass over the text tells which keywords
occur; only the signatures whose keywords all do are tried.  Detections are
ordered by priority; one whose interval lies within that of a detection of
higher priority (or of the same priority and longer) is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame

from .common import kept, map_texts, pick
from .license_rules import Signature, signatures

#: Fixed by the contract: base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

class Scanner:
    """Signatures with their keywords, and the automaton that gates them."""

    def __init__(self):
        import ahocorasick

        self.rules = signatures()
        self.base = [(re.compile(rb"(?<![0-9a-z\x80-\xff])" + rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(
            w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), label, phrase.split()[-1]) for phrase, label in BASE]
        self.gate = ahocorasick.Automaton()
        for word in {"license", *(k for r in self.rules for k in r.keywords)}:
            self.gate.add_word(word, word)
        self.gate.make_automaton()

    def detections(self, low: str, seen: set[str]) -> list[tuple[Signature, int, int]]:
        """What the rules find whose keywords are all in ``seen``, after suppression, in order of priority."""
        found = [(r, m.start(), m.end()) for r in self.rules if seen.issuperset(r.keywords) for m in r.pattern.finditer(low)]
        found.sort(key=lambda d: (-d[0].priority, d[1] - d[2], d[1], d[0].label))
        left: list[tuple[Signature, int, int]] = []
        starts: list[int] = []  # intervals of `left` that no other contains, by start
        ends: list[int] = []
        for rule, a, b in found:
            k = bisect_right(starts, a)
            if k and ends[k - 1] >= b:
                continue
            left.append((rule, a, b))
            while k < len(starts) and ends[k] <= b:  # contained by the new one
                del starts[k], ends[k]
            starts.insert(k, a)
            ends.insert(k, max(b, ends[k - 1] if k else b))
        return left


_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_WORD[128:] = True

SCHEMA = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, detections array<struct<label:string,priority:int,start:bigint,stop:bigint>>")


def scan(text: str, scanner: Scanner) -> tuple:
    """See ``find_licenses``; offsets of detections are code points."""
    low = text.encode("utf-8", "surrogatepass").lower()
    word = _WORD[np.frombuffer(low, np.uint8)]
    begins = np.flatnonzero(word & ~np.concatenate(([False], word[:-1]))) if len(word) else np.empty(0, np.int64)
    chars = low.decode("utf-8", "surrogatepass")
    seen = {w for _, w in scanner.gate.iter(chars)}
    places, base = [], set()
    if "license" in seen:
        for pattern, label, _ in scanner.base:
            at = [m.start() for m in pattern.finditer(low)]
            if at:
                base.add(label)
                places += np.searchsorted(begins, at).tolist()
    found = scanner.detections(chars, seen) if seen else []
    labels = base | {r.label for r, _, _ in found}
    score = max([r.confidence for r, _, _ in found] + [0.7] * bool(base), default=0.0)
    return (len(begins), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score,
            [{"label": r.label, "priority": r.priority, "start": a, "stop": b} for r, a, b in sorted(found, key=lambda d: d[1:])])


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base phrase places, labels, score (0 to 1) and the kept detections.

    ``score`` is the confidence of the surest kept detection, 0 without any.
    Null text counts as empty: no words, null places, empty labels, score 0.
    Null ids pass through, repeated rows give repeated rows, an empty table
    gives an empty result.  Whole texts are scanned.
    """
    def row(text: str) -> tuple:
        return scan(text, kept("licenses", Scanner))

    return map_texts(pick(docs, id=id_col, text=text_col), SCHEMA, row, "id").withColumnRenamed("id", id_col)
