"""Regex-level HTML helpers (JVM-side) used where a full parse is not needed.

The full article extraction (X1) is ``corpusflow.operators.article``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_RE = r"(?is)<title[^>]*>(.*?)</title>"
LANG_RE = r"(?is)<html[^>]*\slang=\"([^\"]*)\""

# fixed: the five predefined XML entities, decoded with &amp; last
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def unescape_sql(expr: str) -> str:
    for ent, ch in ENTITIES:
        expr = f"replace({expr}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return expr

