"""X1 on pages made of documents: main-content scoring, JSON-LD, and accepted articles (P8, P17) with SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.text import WS
from corpusflow.operators import quality as Q
from corpusflow.operators.article import article_fields, extract_articles
from corpusflow.plans import standins
from corpusflow.plans.registry import register

_TITLE = ("Report number ", " from the archive of documents")


def document_pages(spark, sf_dir):
    """Stand-in pages without ``<article>``: each line of a document is a paragraph of one ``div`` among menus, notes and comments.

    The date stands in JSON-LD (even ids) or in a meta tag (odd ids), and
    nowhere for every fifth id; the authors stand in JSON-LD.
    """
    a = standins.articles(spark, sf_dir)
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.when(F.col("id") % 5 != 0, F.date_format("publish_date", "yyyy-MM-dd"))
    ld = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.when(F.col("id") % 2 == 0, F.concat(day, F.lit("T08:00:00Z"))).alias("datePublished"),
                            F.array(F.struct(F.concat(F.lit("Desk "), F.col("source")).alias("name")), F.struct(F.lit("Ann Lee").alias("name"))).alias("author")))
    meta = F.when(F.col("id") % 2 != 0, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('">')))
    pars = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("<p>"), esc(x), F.lit("</p>"))), "\n")
    links = "".join(f'<li><a href="/{k}">Section number {k} of the site</a></li>' for k in range(12))
    html = F.concat(
        F.lit('<html lang="'), F.col("lang"), F.lit('"><head><title>'), F.lit(_TITLE[0]), F.col("id").cast("string"), F.lit(_TITLE[1] + "</title>"),
        F.coalesce(meta, F.lit("")), F.lit('<script type="application/ld+json">'), ld, F.lit(f"</script></head><body><div class=menu><ul>{links}</ul></div>"),
        F.lit('<div id=page><div class=promo><p>Subscribe now.</p></div><div class="story">'), pars,
        F.lit(f'</div><div class=related><p>See also <a href="/x">another long report from the archive</a></p></div>'
              "<div class=comments><p>Nice read.</p></div></div></body></html>"))
    return a.select("id", "lang", html.alias("html"))


_STORY_SQL = f"""{standins.ARTICLES_SQL.strip()},
story AS (
  SELECT id, lang, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
           lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), chr(10)) AS story,
         '{_TITLE[0]}' || CAST(id AS VARCHAR) || '{_TITLE[1]}' AS title, 'Desk ' || source || ', Ann Lee' AS authors,
         CASE WHEN id % 5 <> 0 THEN strftime(publish_date, '%m-%d-%Y') END AS publish_date FROM articles),
gated AS (SELECT *, CASE WHEN publish_date IS NULL THEN 'date' WHEN length(story) < {Q.MIN_TEXT_CHARS} THEN 'len'
                         WHEN lang <> '{Q.LANGUAGE}' THEN 'lang' END AS reject_reason FROM story)"""


def _gated(spark, sf_dir):
    art = article_fields(extract_articles(document_pages(spark, sf_dir), "html", ["id"]))
    return Q.quality_gate(art, date_col="publish_date", text_col="text", title_col="title", lang_col="meta_lang")


@register("story_articles", f"""WITH {_STORY_SQL}
SELECT id, title, CAST(length(story) AS BIGINT) AS text_chars, md5(story) AS text_digest, authors, publish_date, 'success' AS status,
       CAST(NULL AS VARCHAR) AS parse_error
FROM gated WHERE reject_reason IS NULL""")
def story_articles(spark, sf_dir):
    """X1 -> P8 -> P17: accepted articles of pages without ``<article>``: whole text, authors and date."""
    kept = Q.mark_success(_gated(spark, sf_dir).where(F.col("reject_reason").isNull()), url_col="title", domain_col="meta_lang", warc_date_col="publish_date")
    return kept.select("id", "title", F.length("text").cast("long").alias("text_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_digest"),
                       F.array_join("authors", ", ").alias("authors"), "publish_date", "status", "parse_error")


@register("story_funnel", f"""WITH {_STORY_SQL}
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1""")
def story_funnel(spark, sf_dir):
    """A4 on the same pages: pages per first failure."""
    return Q.funnel(_gated(spark, sf_dir))
