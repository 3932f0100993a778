"""Store and calendar queries over the article stand-in (``documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.operators import calendar as C
from corpusflow.operators import store as S
from corpusflow.operators.pairs import window_file_name
from corpusflow.plans import standins
from corpusflow.plans.registry import register
from corpusflow.sources.tables import table

A = standins.ARTICLES_SQL.strip()


@register("unique_text", """SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang,
  arg_min(source, doc_id) AS source, arg_min(n_chars, doc_id) AS n_chars, count(*) AS copies
FROM documents GROUP BY text""")
def unique_text(spark, sf_dir):
    """The store keeps the first row per text in load order (doc_id); nulls are one text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return S.unique_first(docs, "text", ["doc_id"], count_col="copies").drop("text")


@register("insert_absent", """WITH firsts AS (
  SELECT text, arg_min(doc_id, doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY text),
stored AS (SELECT DISTINCT d.text FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, n_chars FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.text IS NOT DISTINCT FROM f.text)""")
def insert_absent(spark, sf_dir):
    """Documents a store already holding the labelled documents would still accept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return S.insert_absent(labelled, docs, "text", ["doc_id"]).select("doc_id", "n_chars")


def _raw_dates(spark, sf_dir):
    """Stand-in raw date strings: the crawl's form for English rows, ISO text for the rest."""
    a = standins.articles(spark, sf_dir)
    raw = F.when(F.col("lang") == "en", F.date_format("publish_date", S.DATE_FORMAT)) \
           .otherwise(F.date_format("publish_date", "yyyy-MM-dd"))
    return a.select(F.col("id").alias("doc_id"), raw.alias("publish_date_raw"))


@register("parse_dates", f"""WITH {A}
SELECT id AS doc_id,
  CAST(try_strptime(CASE WHEN lang = 'en' THEN strftime(publish_date, '%m-%d-%Y') ELSE strftime(publish_date, '%Y-%m-%d') END,
                    '%m-%d-%Y') AS DATE) AS publish_date,
  CASE WHEN lang = 'en' THEN strftime(publish_date, '%m-%d-%Y') ELSE strftime(publish_date, '%Y-%m-%d') END AS publish_date_raw
FROM articles""")
def parse_dates(spark, sf_dir):
    """``MM-dd-yyyy`` text to date; unparsable text keeps the raw string and a null date."""
    raw = _raw_dates(spark, sf_dir)
    return raw.select("doc_id", S.parse_publish_date("publish_date_raw").alias("publish_date"),
                      "publish_date_raw")


@register("articles_by_month", f"""WITH {A}
SELECT CAST(year(publish_date) AS INTEGER) AS year, CAST(month(publish_date) AS INTEGER) AS month, count(*) AS n
FROM articles WHERE publish_date IS NOT NULL GROUP BY 1, 2
HAVING count(*) >= {C.MIN_COUNT} AND min(year(publish_date)) >= {C.MIN_YEAR}""")
def articles_by_month(spark, sf_dir):
    """A1: article count per (year, month), gated at 10 articles and year >= 1990."""
    return C.articles_by_month(standins.articles(spark, sf_dir))


_DATES_SQL = f"""{A},
qd AS (SELECT publish_date, count(*) AS n FROM articles WHERE publish_date IS NOT NULL
       GROUP BY publish_date HAVING count(*) >= {C.MIN_COUNT} AND year(publish_date) >= {C.MIN_YEAR}),
rk AS (SELECT publish_date, row_number() OVER (ORDER BY publish_date) - 1 AS rn FROM qd),
win AS (SELECT CAST(floor(rn / 2) AS BIGINT) AS window_id, min(publish_date) AS start, max(publish_date) AS "end"
        FROM rk GROUP BY 1 HAVING count(*) = 2),
wa AS (SELECT w.window_id, a.* FROM articles a JOIN win w ON a.publish_date BETWEEN w.start AND w."end")"""


@register("qualifying_dates", f"WITH {_DATES_SQL} SELECT publish_date, n FROM qd")
def qualifying_dates(spark, sf_dir):
    """A2: dates with at least 10 articles from 1990 on."""
    return C.qualifying_dates(standins.articles(spark, sf_dir))


def _windows(spark, sf_dir):
    return C.date_windows(C.qualifying_dates(standins.articles(spark, sf_dir)))


@register("date_windows", f"""WITH {_DATES_SQL}
SELECT window_id, start, "end",
  concat_ws('-', year(start), month(start), day(start)) || '-to-' || concat_ws('-', year("end"), month("end"), day("end"))
    || '-sister-articles.jsonl' AS file_name
FROM win""")
def date_windows(spark, sf_dir):
    """Consecutive qualifying dates paired without overlap, with the window file name."""
    return _windows(spark, sf_dir).withColumn("file_name", window_file_name("start", "end"))


@register("window_articles", f"WITH {_DATES_SQL} SELECT window_id, id, publish_date FROM wa")
def window_articles(spark, sf_dir):
    """Inclusive range join of articles to windows (day-expanded, broadcast days)."""
    a = standins.articles(spark, sf_dir)
    return C.window_articles(a, _windows(spark, sf_dir)).select("window_id", "id", "publish_date")


@register("window_dedup", f"""WITH {_DATES_SQL},
keyed AS (SELECT *, title || ' -- ' || sha256(text) AS k FROM wa WHERE title IS NOT NULL AND text IS NOT NULL)
SELECT window_id, arg_min(id, (publish_date, id)) AS id, min(publish_date) AS publish_date, count(*) AS copies
FROM keyed GROUP BY window_id, k""")
def window_dedup(spark, sf_dir):
    """One article per (window, title, whole text), earliest date wins."""
    a = standins.articles(spark, sf_dir)
    rows = C.window_articles(a, _windows(spark, sf_dir))
    return C.window_dedup(rows).select("window_id", "id", "publish_date", "copies")
