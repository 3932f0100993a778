"""URL column expressions (regular expressions, JVM-side).

Patterns are plain regular expressions understood the same way by Java and
RE2, so the oracle SQL can reuse them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.-]*:"
HOST_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)"
PATH_RE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)"
PARAMS_RE = r";[^/]*$"
# extension of the last path segment; names starting with a dot have none
EXT_RE = r"[^/.][^/]*\.([^./]*)$"
# fixed values of the URL gate: maximum length and the "two endings" pattern
MAX_URL_LENGTH = 200
ENDINGS_RE = r"\.com|\.co\.uk|\.net|\.org"

_META = set(".^$*+?()[]{}|\\")


def escape_literal(s: str) -> str:
    """Escape regex metacharacters so ``s`` matches literally (Java and RE2 alike)."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def literal_alternation(literals) -> str:
    seen, parts = set(), []
    for lit in literals:
        if lit not in seen:
            seen.add(lit)
            parts.append(escape_literal(lit))
    return "(" + "|".join(parts) + ")"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(_c(url), HOST_RE, 1))


def path(url: str | Column) -> Column:
    """Path without query and fragment (params still attached)."""
    return F.regexp_extract(_c(url), PATH_RE, 1)


def extension(url: str | Column) -> Column:
    """Extension of the last path segment, without the dot; '' when none (params cut off)."""
    p = F.regexp_replace(path(url), PARAMS_RE, "")
    return F.regexp_extract(p, EXT_RE, 1)


def clean_url(url: str | Column) -> Column:
    """drop query and fragment, keep params, lower-case the scheme."""
    no_q = F.regexp_replace(_c(url), r"[?#].*$", "")
    scheme = F.regexp_extract(no_q, SCHEME_RE, 0)
    return F.concat(F.lower(scheme), F.substr(no_q, F.length(scheme) + 1))


def endings_count(url: str | Column) -> Column:
    """Number of ``.com``/``.co.uk``/``.net``/``.org`` in the whole URL (substring matches)."""
    return F.regexp_count(_c(url), F.lit(ENDINGS_RE))
