"""Text rules and the quality gate over an extracted-article stand-in built from ``documents``.

Stand-in (rows only, no rule applied): the first line is the page title,
lines 2-4 are the three meta descriptions (og, twitter, plain), the first
line split at ". " gives author names, the date text is the crawl's form for
English rows and ISO text otherwise, ``lang`` is the page language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import quality as Q
from corpusflow.operators import store as S
from corpusflow.plans.registry import register
from corpusflow.plans.sqlgen import s
from corpusflow.sources.tables import table


def raw_articles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("doc_id") * F.col("doc_id"), F.lit(211)).cast("int"))
    return docs.select(
        "doc_id", "text", F.col("lang").alias("meta_lang"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.get(lines, 1).alias("og_description"), F.get(lines, 2).alias("twitter_description"),
        F.get(lines, 3).alias("description"),
        F.split(F.substring_index("text", "\n", 1), r"\. ").alias("authors_raw"),
        F.when(F.col("doc_id") % 7 != 0, F.date_format(date, S.DATE_FORMAT))
         .otherwise(F.date_format(date, "yyyy-MM-dd")).alias("publish_date_raw"))


def extracted_articles(spark, sf_dir):
    """Apply F1, F2, F5, P9 and F7 exactly as the extraction step does."""
    r = raw_articles(spark, sf_dir)
    return r.select(
        "doc_id", "meta_lang", "title",
        X.strip_title(X.collapse_newlines("text"), "title").alias("text"),
        X.summary_cascade("og_description", "twitter_description", "description").alias("summary"),
        X.keep_authors("authors_raw").alias("authors"),
        S.parse_publish_date("publish_date_raw").alias("publish_date"))


NL = "chr(10)"
_RAW_SQL = f"""raw AS (
  SELECT doc_id, text, lang AS meta_lang, split_part(text, {NL}, 1) AS title,
         string_split(text, {NL})[2] AS og_description, string_split(text, {NL})[3] AS twitter_description,
         string_split(text, {NL})[4] AS description,
         string_split(split_part(text, {NL}, 1), '. ') AS authors_raw,
         CASE WHEN doc_id % 7 <> 0 THEN strftime(CAST(DATE '2024-01-01' + CAST(((doc_id * doc_id) % 211) AS INTEGER) AS DATE), '%m-%d-%Y')
              ELSE strftime(CAST(DATE '2024-01-01' + CAST(((doc_id * doc_id) % 211) AS INTEGER) AS DATE), '%Y-%m-%d') END AS publish_date_raw
  FROM documents)"""


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {s(X.STRIP_RE)}, '', 'g')"


def _cascade(*cands: str) -> str:
    parts = [f"CASE WHEN length({_strip(c)}) > {X.SUMMARY_MIN_CHARS} THEN {_strip(c)} END" for c in cands]
    return "coalesce(" + ", ".join(parts) + ")"


_COLLAPSED = f"regexp_replace(text, {s(X.NEWLINE_RUN_RE)}, {NL}, 'g')"
_ART_SQL = _RAW_SQL + f""",
art AS (
  SELECT doc_id, meta_lang, title,
    CASE WHEN title IS NOT NULL AND starts_with({_COLLAPSED}, title || {NL})
         THEN regexp_replace(substr({_COLLAPSED}, length(title) + 1), '^\\n+', '') ELSE {_COLLAPSED} END AS text,
    {_cascade("og_description", "twitter_description", "description")} AS summary,
    list_filter(authors_raw, lambda a: len(string_split(a, ' ')) < {X.AUTHOR_MAX_PARTS}) AS authors,
    CAST(try_strptime(publish_date_raw, '%m-%d-%Y') AS DATE) AS publish_date
  FROM raw)"""


@register("newline_collapse", f"""WITH {_RAW_SQL}
SELECT doc_id, {_COLLAPSED} AS text, length(text) AS chars_before, length({_COLLAPSED}) AS chars_after FROM raw""")
def newline_collapse(spark, sf_dir):
    """newline + following (Unicode) whitespace collapsed to one newline, whole texts."""
    docs = table(spark, sf_dir, "documents")
    c = X.collapse_newlines("text")
    return docs.select("doc_id", c.alias("text"), F.length("text").cast("long").alias("chars_before"),
                       F.length(c).cast("long").alias("chars_after"))


@register("title_strip", f"WITH {_ART_SQL} SELECT doc_id, title, text FROM art")
def title_strip(spark, sf_dir):
    """F2 after F1: text without the leading title line."""
    return extracted_articles(spark, sf_dir).select("doc_id", "title", "text")


@register("summary_cascade", f"WITH {_ART_SQL} SELECT doc_id, summary FROM art")
def summary_cascade(spark, sf_dir):
    """og, then twitter, then plain description; first stripped one over 30 chars."""
    return extracted_articles(spark, sf_dir).select("doc_id", "summary")


@register("author_filter", f"""WITH {_ART_SQL.replace('FROM raw)', 'FROM raw), j AS (SELECT a.*, r.authors_raw FROM art a JOIN raw r USING (doc_id))')}
SELECT doc_id, CAST(len(authors_raw) AS BIGINT) AS n_authors, CAST(len(authors) AS BIGINT) AS n_kept,
       array_to_string(authors, '|') AS kept
FROM j""")
def author_filter(spark, sf_dir):
    """Author names with fewer than 10 space-separated parts."""
    r = raw_articles(spark, sf_dir)
    kept = X.keep_authors("authors_raw")
    return r.select("doc_id", F.size("authors_raw").cast("long").alias("n_authors"),
                    F.size(kept).cast("long").alias("n_kept"), F.array_join(kept, "|").alias("kept"))


@register("empty_fields", f"""WITH {_ART_SQL},
e AS (SELECT (CASE WHEN meta_lang IS NULL OR meta_lang = '' THEN 1 ELSE 0 END)
           + (CASE WHEN title IS NULL OR title = '' THEN 1 ELSE 0 END)
           + (CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END)
           + (CASE WHEN summary IS NULL OR summary = '' THEN 1 ELSE 0 END)
           + (CASE WHEN authors IS NULL OR len(authors) = 0 THEN 1 ELSE 0 END)
           + (CASE WHEN publish_date IS NULL THEN 1 ELSE 0 END) AS n_empty FROM art)
SELECT CAST(n_empty AS BIGINT) AS n_empty, count(*) AS articles FROM e GROUP BY 1""")
def empty_fields(spark, sf_dir):
    """A5: histogram of the number of empty fields (null, "", []) per extracted article."""
    a = extracted_articles(spark, sf_dir)
    fields = ["meta_lang", "title", "text", "summary", "authors", "publish_date"]
    return (a.select(Q.empty_field_count(a, fields).alias("n_empty"))
            .groupBy("n_empty").agg(F.count(F.lit(1)).alias("articles")))


_GATE_SQL = _ART_SQL + f""",
gated AS (SELECT *, CASE
    WHEN publish_date IS NULL THEN 'date'
    WHEN coalesce(length(text), 0) < {Q.MIN_TEXT_CHARS} THEN 'len'
    WHEN coalesce(length(title), 0) < {Q.MIN_TITLE_CHARS} THEN 'title'
    WHEN NOT coalesce(meta_lang = '{Q.LANGUAGE}', false) THEN 'lang' END AS reject_reason FROM art)"""


@register("article_quality_funnel", f"""WITH {_GATE_SQL}
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1""")
def article_quality_funnel(spark, sf_dir):
    """P8 + A4: date, length, title and language checks in order; rows per first failure."""
    return Q.funnel(Q.quality_gate(extracted_articles(spark, sf_dir)))


@register("accepted_articles", f"""WITH {_GATE_SQL}
SELECT doc_id, title, length(text) AS text_chars, summary, publish_date FROM gated WHERE reject_reason IS NULL""")
def accepted_articles(spark, sf_dir):
    """The articles that pass the gate."""
    g = Q.quality_gate(extracted_articles(spark, sf_dir))
    return g.where(F.col("reject_reason").isNull()).select(
        "doc_id", "title", F.length("text").cast("long").alias("text_chars"), "summary", "publish_date")
