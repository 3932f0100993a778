"""3.1 archive -> article rows: P6, URL gate, P7, X1, article rules, P8, P17.

Cheap checks run first and stay below the Python parse in the plan: record
kind (P6) and the URL gate are column expressions on the record headers; the
payload is only decoded (P7: valid UTF-8, non-empty) for rows that pass, and
only those reach ``mapInArrow``.  ``reject_reason`` names the first failed
check (``kind``, URL gate reasons, ``parse``, then ``date``/``len``/``title``/``lang``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import quality as Q
from corpusflow.operators import url_gate as G
from corpusflow.operators.article import article_fields, extract_articles

# fixed: the record kind the ingest accepts
RESPONSE_TYPE = "response"
RESPONSE_CONTENT_TYPE = "application/http; msgtype=response"


def gate_records(records: DataFrame, allow: DataFrame, rules: DataFrame) -> DataFrame:
    """P6 + URL gate + P7 on archive records; adds ``reject_reason`` and ``html`` (accepted rows)."""
    kind_ok = (F.col("rec_type") == RESPONSE_TYPE) & (F.col("content_type") == RESPONSE_CONTENT_TYPE)
    kinds = records.withColumn("_kind_ok", F.coalesce(kind_ok, F.lit(False)))
    gated = G.url_gate(kinds.withColumn("url", F.col("target_uri")), allow, rules)
    utf8_ok = F.is_valid_utf8(F.col("payload")) & (F.length("payload") > 0)
    reason = (F.when(~F.col("_kind_ok"), "kind")
              .when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
              .when(~F.coalesce(utf8_ok, F.lit(False)), "parse"))
    out = gated.withColumn("reject_reason", reason)
    return out.withColumn("html", F.when(F.col("reject_reason").isNull(),
                                         F.decode(F.col("payload"), "UTF-8"))).drop("_kind_ok", "payload")


def records_to_articles(records: DataFrame, allow: DataFrame, rules: DataFrame) -> DataFrame:
    """All records with ``reject_reason``; accepted ones carry the article (M3) fields."""
    gated = gate_records(records, allow, rules)
    keep = ["file", "offset", "clean_url", "registered_domain", "warc_date"]
    passed = gated.where(F.col("reject_reason").isNull())
    art = article_fields(extract_articles(passed, "html", keep))
    art = Q.quality_gate(art, date_col="publish_date", text_col="text", title_col="title", lang_col="meta_lang")
    art = Q.mark_success(art)
    failed = gated.where(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")
    return art.unionByName(failed, allowMissingColumns=True)


def page_articles(pages: DataFrame, allow: DataFrame, rules: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Same flow for pages already split into (url, html): URL gate, X1, article rules, P8."""
    gated = G.url_gate(pages, allow, rules)
    keep = [id_col, "clean_url", "registered_domain"]
    passed = gated.where(F.col("reject_reason").isNull())
    art = article_fields(extract_articles(passed, "html", keep))
    art = Q.quality_gate(art, date_col="publish_date", text_col="text", title_col="title", lang_col="meta_lang")
    failed = gated.where(F.col("reject_reason").isNotNull()).select(*keep, "reject_reason")
    return art.unionByName(failed, allowMissingColumns=True)
