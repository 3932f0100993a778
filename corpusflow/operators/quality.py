"""The article quality gate, its funnel and the empty-field count.

Gate, in order (first failure names the reason, null = kept):
``date`` no publish date; ``len`` text shorter than 1000 characters;
``title`` title shorter than 30 characters; ``lang`` language not exactly ``en``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the quality gate
MIN_TEXT_CHARS = 1000
MIN_TITLE_CHARS = 30
LANGUAGE = "en"


def reject_reason(date_col: str = "publish_date", text_col: str = "text", title_col: str = "title",
                  lang_col: str = "meta_lang") -> Column:
    return (F.when(F.col(date_col).isNull(), "date")
            .when(F.coalesce(F.length(text_col), F.lit(0)) < MIN_TEXT_CHARS, "len")
            .when(F.coalesce(F.length(title_col), F.lit(0)) < MIN_TITLE_CHARS, "title")
            .when(~F.coalesce(F.col(lang_col) == LANGUAGE, F.lit(False)), "lang"))


def quality_gate(articles: DataFrame, **cols) -> DataFrame:
    """All rows plus ``reject_reason``."""
    return articles.withColumn("reject_reason", reject_reason(**cols))


def funnel(gated: DataFrame) -> DataFrame:
    """A4: rows per reject reason (``accepted`` for kept rows)."""
    return (gated.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def mark_success(accepted: DataFrame, url_col: str = "clean_url", domain_col: str = "registered_domain",
                 warc_date_col: str = "warc_date") -> DataFrame:
    """Constant status and provenance on accepted articles."""
    return (accepted.withColumn("status", F.lit("success"))
            .withColumn("url", F.col(url_col)).withColumn("domain", F.col(domain_col))
            .withColumn("warc_date", F.col(warc_date_col)))


def empty_field_count(df: DataFrame, fields) -> Column:
    """A5: number of ``fields`` that are null, ``""`` or an empty array."""
    terms = []
    for f in fields:
        dtype = df.schema[f].dataType
        c = F.col(f)
        if isinstance(dtype, T.StringType):
            e = c.isNull() | (c == "")
        elif isinstance(dtype, T.ArrayType):
            e = c.isNull() | (F.size(c) == 0)
        else:
            e = c.isNull()
        terms.append(F.when(e, 1).otherwise(0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total.cast("long")
