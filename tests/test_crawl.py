"""X1 extraction, the WARC source and the archive ingest flow."""

import os
import tempfile

from corpusflow.operators import article, crawl
from corpusflow.operators import url_gate as G
from corpusflow.sources import warc

BODY = ("x" * 60 + ". ") * 20
PAGE = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">
<title>A title that is comfortably longer than thirty chars</title>
<meta property="og:description" content="short">
<meta name="twitter:description" content="  a twitter description that is long enough to win  ">
<meta name="author" content="Ann Lee, Bob Stone and Cy Twombly">
<meta property="article:published_time" content="2021-02-03T10:00:00Z">
<script>var t="</p>";</script></head><body><nav>menu</nav><div class="ad">buy</div>
<article><h1>A title that is comfortably longer than thirty chars</h1><p>{BODY}</p><p>second  para</p></article>
<footer>foot</footer></body></html>"""


def test_parse_html_rules():
    title, text, authors, date, og, tw, desc, lang = article.parse_html(PAGE)
    assert title == "A title that is comfortably longer than thirty chars"
    assert lang == "en" and date.startswith("2021-02-03")
    assert authors == ["Ann Lee", "Bob Stone", "Cy Twombly"]
    assert text == BODY.strip() + "\n\nsecond  para"
    assert "menu" not in text and "buy" not in text and "foot" not in text
    assert og == "short" and tw.strip().startswith("a twitter")


def test_warc_source_and_ingest(spark):
    folder = tempfile.mkdtemp(prefix="cf-warc-", dir="/tmp")
    path = os.path.join(folder, "a.warc.gz")
    warc.write_warc(path, [("http://good.com/news/1", "2021-02-03T00:00:00Z", PAGE),
                           ("http://good.com/img.png", "2021-02-03T00:00:00Z", PAGE),
                           ("http://bad.com/news/2", "2021-02-03T00:00:00Z", PAGE),
                           ("http://good.com/news/3", "2021-02-03T00:00:00Z", b"\xff\xfe bad utf8")])
    warc.register_warc(spark)
    recs = spark.read.format("warc").option("paths", path).load()
    assert recs.count() == 4
    allow = G.allow_list_df(spark, {"good.com": True})
    out = crawl.records_to_articles(recs, allow, G.suffix_rules_df(spark))
    reasons = sorted((r["clean_url"], r["reject_reason"]) for r in out.collect())
    assert reasons == [("http://bad.com/news/2", "domain"), ("http://good.com/img.png", "extension"),
                       ("http://good.com/news/1", None), ("http://good.com/news/3", "parse")]
    ok = out.where("reject_reason is null").first()
    assert ok["status"] == "success" and ok["publish_date"] == "02-03-2021" and ok["domain"] == "good.com"
    assert ok["summary"].startswith("a twitter description")


def test_filters_stay_below_python_stage(spark):
    pages = spark.createDataFrame([(1, "http://good.com/a", PAGE)], "page_id long, url string, html string")
    df = crawl.page_articles(pages, G.allow_list_df(spark, {"good.com": True}), G.suffix_rules_df(spark))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the URL gate filter is evaluated in the child of the Arrow map stage
    arrow = plan.find("MapInArrow") if "MapInArrow" in plan else plan.find("PythonMapInArrow")
    assert arrow >= 0
    assert "isnull(reject_reason" in plan[arrow:] or "isnull(CASE" in plan[arrow:] or "Filter" in plan[arrow:]


def test_text_before_the_article_is_no_paragraph_of_it():
    r = article.parse_html("<body><div>Cookie banner</div><article><p>Body one</p></article></body>")
    assert r[1] == "Body one"


def test_unclosed_skipped_blocks_do_not_swallow_the_rest():
    r = article.parse_html('<body><p class="ad">Buy now<p>Real para one<p>Real para two</body>')
    assert r[1] == "Real para one\n\nReal para two"
    r = article.parse_html('<body><ul><li class="ad">Buy <b>now<li>item</ul><div><p class="ads">x</div><p>after</p></body>')
    assert r[1] == "item\n\nafter"
    r = article.parse_html('<body><div class="ad"><p>a<p>b</div><p>kept</body>')
    assert r[1] == "kept"


def test_read_warc_isolates_a_damaged_archive(spark):
    folder = tempfile.mkdtemp(prefix="cf-warc-", dir="/tmp")
    good, bad = os.path.join(folder, "good.warc.gz"), os.path.join(folder, "bad.warc.gz")
    rows = [(f"http://good.com/{k}", "2021-02-03T00:00:00Z", PAGE) for k in range(5)]
    warc.write_warc(good, rows)
    warc.write_warc(bad, rows)
    with open(bad, "rb") as f:
        data = f.read()
    with open(bad, "wb") as f:
        f.write(data[:-len(data) // 10])
    recs = warc.read_warc(spark, folder, "*.warc.gz")
    status = {os.path.basename(r["file"]): (r["records"], r["error"] is None) for r in warc.archive_status(recs).collect()}
    assert status["good.warc.gz"] == (5, True)
    assert status["bad.warc.gz"] in ((3, False), (4, False))  # the stream reads ahead of the record it gives
    old = {(r["target_uri"], bytes(r["payload"])) for r in _source(spark, good).collect()}
    assert old == {(r["target_uri"], bytes(r["payload"])) for r in recs.where("file like '%good%'").collect()}


def _source(spark, path):
    warc.register_warc(spark)
    return spark.read.format("warc").option("paths", path).load()


LINKS = "".join(f"<li><a href='/{k}'>A long link text number {k}</a></li>" for k in range(20))


def test_main_content_without_an_article_element():
    story = [f"Paragraph {k} of the story, with some words in it." for k in range(6)]
    page = ("<html><body><div><ul>" + LINKS + "</ul></div><div><div><p>Buy our paper.</p></div><div class=x>Lead without a paragraph"
            + "".join(f"<p>{p}</p>" for p in story) + "<div><p>Last part, in a box of its own.</p></div></div><div><p>A comment.</p></div></div></body></html>")
    assert article.parse_html(page)[1].split("\n\n") == ["Lead without a paragraph", *story, "Last part, in a box of its own."]
    # paragraphs that are mostly links are left out, a link inside running text is not
    page = "<body><p>Some words with <a href=x>a link</a> inside of a sentence.</p><p>More: <a href=y>a whole long list of links</a></p></body>"
    assert article.parse_html(page)[1] == "Some words with a link inside of a sentence."
    # end tags without start tags, start tags without end tags, very deep nesting
    assert article.parse_html("</div><div><div><p>a b c d e</p></section></td>")[1] == "a b c d e"
    assert article.parse_html("<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000)[1] == "deep"


def test_linked_data_and_parse_errors():
    ld = '{"@graph": [{"@type": "NewsArticle", "datePublished": "2022-05-06T01:00:00Z", "author": [{"name": "Ann Lee"}, "Bob Stone", {"name": " "}]}]}'
    page = f'<html><head><script type="application/ld+json">{ld}</script><script type="application/ld+json">not json</script></head><body><p>x</p></body></html>'
    r = article.parse_page(page)
    assert r[2] == ["Ann Lee", "Bob Stone"] and r[3].startswith("2022-05-06") and r[8] is None
    deep = '<script type="application/ld+json">' + '{"a":' * 50_000 + "</script><body><p>x</p></body>"
    assert article.parse_page(deep)[1] == "x"
    meta = page.replace("<head>", '<head><meta name="author" content="Cy Twombly"><meta name="date" content="2020-01-01">')
    assert article.parse_page(meta)[2] == ["Cy Twombly", "Ann Lee", "Bob Stone"] and article.parse_page(meta)[3] == "2020-01-01"
    assert article.parse_page(None)[8] is None and len(article.parse_page("<p>")) == 9
