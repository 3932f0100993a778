"""Secret scans: Aho-Corasick prefilter, anchored regular expressions at its hits, embedded checksums.

One automaton over all keywords passes once over each lower-cased text.  Where
a keyword ends, only the rules of that keyword are tried, anchored at the
place.  Long hexadecimal runs have no keyword; they are found from the byte
classes of the whole text.  Rules of the method that carry a checksum (tokens
with a CRC-32 suffix, payment card numbers, IBANs, signed web tokens) keep a
match only if the checksum holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_texts, pick, positional, slices

#: Fixed by the contract: keywords, patterns and least lengths of the base kinds, in order of listing.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(found: bytes) -> bool:
    """The last six characters are the CRC-32 of the part after the prefix, in base 62."""
    body = found[found.index(b"_") + 1:]
    n = 0
    for ch in body[-6:]:
        n = n * 62 + _BASE62.index(ch)
    return zlib.crc32(body[:-6]) == n


def luhn(found: bytes) -> bool:
    digits = [c - 48 for c in found if 48 <= c <= 57]
    doubled = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return len(set(digits)) > 1 and doubled % 10 == 0


def iban(found: bytes) -> bool:
    """The number with its first four characters moved to the end, letters as 10 to 35, is 1 modulo 97."""
    plain = found.replace(b" ", b"").decode()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def web_token(found: bytes) -> bool:
    """The first part is base64url JSON that names an algorithm (JSON nested deeper than Python reads is none)."""
    head = found.split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def match_end(data: bytes, at: int) -> int:
    return at


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]  # lower case; the expression is anchored where one starts
    pattern: re.Pattern[bytes]
    check: Callable[[bytes], bool]
    end: Callable[[bytes, int], int] = match_end  # where the span ends, by where the match does


def _always(_: bytes) -> bool:
    return True


_PRIVATE = rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
_PRIVATE_END = re.compile(rb"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_BREAK = rb"(?:[\x20\t]*(?:[\r\n]|\\[rn]))"  # line ends, also escaped as in JSON
#: Lines of base64 or encryption headers; runs of base64 that are long if only blanks stand before them.
_KEY_LINES = re.compile(
    rb"(?:" + _BREAK + rb"+[\x20\t]*(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*|[A-Za-z0-9+/]+={0,2})"
    rb"(?=" + _BREAK + rb"|[\x20\t]*(?:[\"'`]|\Z))|[\x20\t]*[A-Za-z0-9+/]{40,}={0,2})*")


def key_end(data: bytes, at: int) -> int:
    """The end of the END line of a private key whose BEGIN line ends at ``at``; without one before the next BEGIN, of its base64 lines."""
    following = data.find(b"-----BEGIN ", at)
    until = len(data) if following < 0 else following
    m = _PRIVATE_END.search(data, at, until) or _KEY_LINES.match(data, at, until)
    return m.end()


RULES = (
    Rule("forge", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_suffix),
    Rule("package", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_suffix),
    Rule("webtoken", ("eyj",), re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"), web_token),
    Rule("private", ("-----begin ",), re.compile(_PRIVATE), _always, key_end),
    Rule("chat", ("xoxb-", "xoxp-", "xoxa-", "xoxr-"), re.compile(rb"xox[bpar]-[0-9]{8,}+-[A-Za-z0-9-]{10,}+"), _always),
)
#: Numbers have no keyword; runs of digits are found from the byte classes and tried here.
CARD = re.compile(rb"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])")
IBAN = re.compile(rb"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True


def automaton():
    import ahocorasick

    words: dict[str, list[Rule | str]] = {}
    for k in ASSIGN_KEYWORDS:
        words.setdefault(k, []).append("assign")
    words.setdefault("akia", []).append("access")
    for rule in RULES:
        for k in rule.keywords:
            words.setdefault(k, []).append(rule)
    a = ahocorasick.Automaton()
    for k, rules in words.items():
        a.add_word(k, (len(k), rules))
    a.make_automaton()
    return a


def _runs(raw: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], table[raw], [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def scan(text: str, machine) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is a base span) in code points, by start, then kind in order of listing.

    Base kinds are leftmost non-overlapping matches of their expression; those
    that are too short are dropped but still use up their text.  The other
    rules are not tried inside their own last match, so each byte is read a
    bounded number of times by each rule.
    """
    data = text.encode("utf-8", "surrogatepass")
    low = data.lower()  # bytes: changes A-Z only
    found: list[tuple[str, int, int, bool]] = []
    after = {"assign": 0, "access": 0}
    hits = sorted(((end + 1 - n, rules) for end, (n, rules) in machine.iter(low.decode("latin-1"))), key=lambda h: h[0])
    for start, rules in hits:
        for rule in rules:
            if rule in after:
                if start < after[rule]:
                    continue
                m = (ASSIGN if rule == "assign" else ACCESS).match(data, start)
                if m:
                    after[rule] = m.end()
                    if m.end() - m.start(2 if rule == "assign" else 0) >= LEAST[rule]:
                        found.append((rule, m.start(), m.end(), True))
            elif start >= after.get(rule.kind, 0):
                m = rule.pattern.match(data, start)
                if m and rule.check(m.group()):
                    after[rule.kind] = rule.end(data, m.end())
                    found.append((rule.kind, m.start(), after[rule.kind], False))
    raw = np.frombuffer(data, np.uint8)
    found += [("hex", a, b, True) for a, b in _runs(raw, _HEX, LEAST["hex"])]
    tried = 0
    for a, _ in _runs(raw, _DIGIT, 2):
        if a < tried:
            continue
        m = CARD.match(data, a)
        if m and 13 <= sum(48 <= c <= 57 for c in m.group()) <= 19 and luhn(m.group()):
            found.append(("card", m.start(), m.end(), False))
            tried = m.end()
        elif a >= 2 and (m := IBAN.match(data, a - 2)) and iban(m.group()):
            found.append(("iban", m.start(), m.end(), False))
            tried = m.end()
    if len(text) != len(data):  # byte offsets to code points
        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        found = [(k, int(points[a]), int(points[b]), base) for k, a, b, base in found]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


KINDS = (*BASE_KINDS, *(r.kind for r in RULES), "card", "iban")


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>"


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of base spans, base_sha256, spans and ``found`` (the spans as structs).

    Null and empty texts have no spans (``spans`` empty, digest of the empty
    string).  Null ids pass through, repeated rows give repeated rows, an empty
    table gives an empty result.  Whole texts are scanned.
    """
    def row(text: str) -> tuple:
        spans = scan(text, kept("secrets", automaton))
        base = [s for s in spans if s[3]]
        n = [sum(s[0] == k for s in base) for k in BASE_KINDS]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                [{"kind": k, "start": a, "stop": b, "base": c} for k, a, b, c in spans])

    return map_texts(pick(docs, id=id_col, text=text_col), SCHEMA, row, "id").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; other columns and null texts stay as they are.

    Overlapping spans are replaced as one.  An empty table gives an empty result.
    """
    names = docs.columns
    k = names.index(text_col)
    rows = positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column(k)
                new = pa.array([None if t is None else clean(t, mark) for t in text.to_pylist()], text.type)
                yield part.set_column(k, part.schema.field(k), new)

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def clean(text: str, mark: str) -> str:
    """``text`` with its spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b, _base in scan(text, kept("secrets", automaton)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
