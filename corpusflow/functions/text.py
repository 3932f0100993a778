"""F1 / F2 / F5 / P9 / F8-style text expressions, JVM-side regular expressions.

Whitespace follows Python's ``str.isspace`` (the reference's ``\\s`` on text),
spelled out as one explicit character class so Java and RE2 agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed: the characters Python treats as whitespace in text patterns
WS = r"[\t\n\x0B\f\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NEWLINE_RUN_RE = r"\n" + WS + "+"
STRIP_RE = "^" + WS + "+|" + WS + "+$"
# fixed values of the article rules: summary must be longer than 30 characters;
# an author name has fewer than 10 space-separated parts
SUMMARY_MIN_CHARS = 30
AUTHOR_MAX_PARTS = 10


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_newlines(text: str | Column) -> Column:
    """a newline followed by whitespace becomes one newline."""
    return F.regexp_replace(_c(text), NEWLINE_RUN_RE, "\n")


def strip_ws(text: str | Column) -> Column:
    """Python ``str.strip()`` with Unicode whitespace."""
    return F.regexp_replace(_c(text), STRIP_RE, "")


def strip_title(text: str | Column, title: str | Column) -> Column:
    """drop the title from the start of the text when a newline follows it, then leading newlines."""
    t = _c(title)

    def strip(x: Column) -> Column:
        starts = F.startswith(x, F.concat(t, F.lit("\n")))
        rest = F.regexp_replace(F.substr(x, F.length(t) + 1), r"^\n+", "")
        return F.when(t.isNotNull() & F.coalesce(starts, F.lit(False)), rest).otherwise(x)

    # the text is bound to a lambda variable, so what makes it is evaluated once
    return F.element_at(F.transform(F.array(_c(text)), strip), 1)


def summary_cascade(*candidates: str | Column, min_chars: int = SUMMARY_MIN_CHARS) -> Column:
    """the first candidate whose stripped text is longer than ``min_chars``, else null."""
    stripped = F.transform(F.array(*[_c(c).cast("string") for c in candidates]), strip_ws)
    return F.get(F.filter(stripped, lambda s: F.length(s) > min_chars), 0)


def keep_authors(authors: str | Column, max_parts: int = AUTHOR_MAX_PARTS) -> Column:
    """Keep names with fewer than ``max_parts`` single-space-separated parts."""
    return F.filter(_c(authors), lambda a: F.size(F.split(a, " ")) < max_parts)
