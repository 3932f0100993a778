"""HTML page -> article fields, one Arrow batch at a time (``mapInArrow``).

Only the parse runs in Python (standard-library ``html.parser``); every rule
on the parsed fields (newline collapse, title strip, summary cascade, author
filter, date format, quality gate) is a JVM column expression applied after.
Callers filter rows *before* this stage (URL gate, record kind, UTF-8), and
select only the columns it needs, so Catalyst keeps that work below the
Python boundary.

Extraction rules (ours; the reference's extraction library is not in the tree):

* title: ``<title>``, else the first ``<h1>``;
* language: ``lang`` of ``<html>``;
* text: paragraphs (``p``, ``h2``-``h6``, ``li``, ``blockquote``, ``pre``, and text
  that stands in a container itself) inside ``<article>`` when the page has
  one, else inside its main container; ``script``, ``style``, ``nav``,
  ``header``, ``footer``, ``aside``, ``form``, ``noscript`` and elements whose
  class names include ``ad``/``ads``/``advert`` are skipped; paragraphs are
  joined by a blank line;
* main container: the smallest element (``div``, ``section``, ``td``, ...) whose
  subtree holds at least ``MAIN_SHARE`` of the page's running text.  A
  paragraph counts with its characters less twice those of its links, not
  below zero; one that is mostly links counts nothing and is left out;
* authors: ``<meta name="author">`` split at commas and " and ", then the names
  of JSON-LD authors, then ``rel="author"`` link texts;
* date: first of ``article:published_time``, ``og:published_time``,
  ``date``/``pubdate`` meta, JSON-LD ``datePublished``, ``<time datetime>``;
* descriptions: ``og:description``, ``twitter:description``, ``description``;
* ``parse_error``: what the parser stopped at (null: it read the whole page).
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import text as X
from corpusflow.operators.store import format_publish_date

SKIP_TAGS = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template"}
BLOCK_TAGS = {"p", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre"}
AD_CLASSES = {"ad", "ads", "advert", "advertisement"}
DATE_META = ("article:published_time", "og:published_time", "date", "pubdate")
# start tags that end an open paragraph, as browsers do for a missing end tag
CLOSE_P = BLOCK_TAGS | {"h1", "div", "section", "article", "main", "ul", "ol", "dl", "table", "hr"} | (SKIP_TAGS - {"script", "style", "noscript", "template"})
#: Elements of the block tree.
CONTAINERS = {"body", "main", "div", "section", "article", "center", "table", "tr", "td", "ul", "ol", "dl", "dd"}
#: Share of the running text that the main container's subtree holds at least; share of links that makes a paragraph a list of links.
MAIN_SHARE, LINK_SHARE = 0.6, 0.5
VOID_TAGS = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed"}

EXTRACT_FIELDS = [
    ("title", T.StringType()), ("text_raw", T.StringType()), ("authors_raw", T.ArrayType(T.StringType())),
    ("date_raw", T.StringType()), ("og_description", T.StringType()),
    ("twitter_description", T.StringType()), ("description", T.StringType()), ("meta_lang", T.StringType()),
    ("parse_error", T.StringType()),
]


class _Block:
    """An element of the block tree: the running text of its subtree."""

    def __init__(self, tag: str, parent: "_Block | None"):
        self.tag, self.parent, self.text = tag, parent, 0
        self.depth = parent.depth + 1 if parent else 0

    def holds(self, other: "_Block | None") -> bool:
        while other is not None and other.depth > self.depth:
            other = other.parent
        return other is self


def _ld_values(data, dates: list[str], authors: list[str], depth: int = 0) -> None:
    """``datePublished`` and author names of a JSON-LD value, wherever they stand."""
    if depth > 20:
        return
    if isinstance(data, list):
        for x in data:
            _ld_values(x, dates, authors, depth + 1)
    elif isinstance(data, dict):
        if isinstance(data.get("datePublished"), str):
            dates.append(data["datePublished"])
        own = data.get("author")
        for x in own if isinstance(own, list) else [own]:
            name = x.get("name") if isinstance(x, dict) else x
            if isinstance(name, str) and name.strip() and name.strip() not in authors:
                authors.append(name.strip())
        for k, x in data.items():
            if k != "author":
                _ld_values(x, dates, authors, depth + 1)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lang = None
        self.title_parts, self.h1_parts = [], []
        self.in_title = self.in_h1 = False
        self.meta: dict[str, str] = {}
        self.skip = 0
        self.skip_stack: list[str] = []
        self.in_body = self.in_article = 0
        self.has_article = False
        self.top = self.block = _Block("html", None)
        self.pars: list[tuple[str, int, _Block]] = []  # text, characters of links, where it stands
        self.article_pars: list[str] = []
        self.cur: list[str] = []
        self.links = self.in_link = 0
        self.in_ld = False
        self.ld: list[str] = []
        self.rel_author = False
        self.authors_links: list[str] = []
        self.time_dt = None

    def _flush(self):
        txt, links = "".join(self.cur).strip(), self.links
        self.cur, self.links = [], 0
        if not txt:
            return
        if self.in_article:
            self.article_pars.append(txt)
        self.pars.append((txt, links, self.block))
        worth = max(0, len(txt) - 2 * links)
        block = self.block
        while worth and block is not None:
            block.text += worth
            block = block.parent

    def _main(self) -> _Block:
        """The smallest element whose subtree holds ``MAIN_SHARE`` of the running text (of equals the deepest)."""
        best = self.top
        for _, _, block in self.pars:
            while block is not None and block.text < MAIN_SHARE * self.top.text:
                block = block.parent
            if block is not None and (block.text, -block.depth) < (best.text, -best.depth):
                best = block
        return best

    def _ends_skipped(self, tag) -> bool:
        """Does this start tag end the open skipped paragraph or list item (its end tag may be missing)?"""
        first = self.skip_stack[0]
        if first == "p":
            return tag in CLOSE_P
        return first == "li" and tag == "li" and not {"ul", "ol"} & set(self.skip_stack)

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        if tag == "html" and a.get("lang"):
            self.lang = a["lang"]
        if tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            if key and "content" in a and key not in self.meta:
                self.meta[key] = a["content"]
            return
        if tag in VOID_TAGS:
            return
        if self.skip and self._ends_skipped(tag):
            self.skip, self.skip_stack = 0, []
        classes = set(a.get("class", "").lower().split())
        if self.skip or tag in SKIP_TAGS or (classes & AD_CLASSES):
            if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
                self.in_ld = True
                self.ld.append("")
            self.skip += 1
            self.skip_stack.append(tag)
            return
        if tag == "title":
            self.in_title = True
        elif tag == "h1":
            self.in_h1 = True
        elif tag == "body":
            self.in_body = 1
        elif tag == "article":
            self._flush()  # what stands before is no text of the article
            self.has_article = True
            self.in_article += 1
        elif tag == "a" and "author" in a.get("rel", "").lower().split():
            self.rel_author = True
        elif tag == "time" and a.get("datetime") and self.time_dt is None:
            self.time_dt = a["datetime"]
        if tag == "a":
            self.in_link += 1
        if tag in BLOCK_TAGS or tag in CONTAINERS:
            self._flush()
            self.in_body = 1
        if tag in CONTAINERS and self.block.depth < 400:
            self.block = _Block(tag, self.block)

    def handle_endtag(self, tag):
        if tag == "script":
            self.in_ld = False
        if self.skip and tag not in self.skip_stack and self.skip_stack[0] in ("p", "li") and tag in CLOSE_P | {"body", "html"}:
            self.skip, self.skip_stack = 0, []  # the parent's end ends the skipped block
        if self.skip:
            if tag in self.skip_stack:
                while self.skip_stack:
                    self.skip -= 1
                    if self.skip_stack.pop() == tag:
                        break
            return
        if tag == "title":
            self.in_title = False
        elif tag == "h1":
            self.in_h1 = False
        elif tag == "a":
            self.rel_author = False
            self.in_link = max(0, self.in_link - 1)
        if tag in BLOCK_TAGS or tag in CONTAINERS:
            self._flush()
            self.in_link = 0
        if tag in CONTAINERS:
            block = self.block
            while block is not None and block.tag != tag:
                block = block.parent
            if block is not None:  # an end tag without its start changes nothing
                self.block = block.parent
        if tag == "article" and self.in_article:
            self.in_article -= 1

    def handle_data(self, data):
        if self.in_ld:
            self.ld[-1] += data
        if self.skip:
            return
        if self.in_title:
            self.title_parts.append(data)
            return
        if self.in_h1:
            self.h1_parts.append(data)
            return
        if self.rel_author and data.strip():
            self.authors_links.append(data.strip())
        if self.in_body or self.in_article:
            self.cur.append(data)
            if self.in_link:
                self.links += len(data.strip())

    def _linked_data(self) -> tuple[list[str], list[str]]:
        dates: list[str] = []
        authors: list[str] = []
        for text in self.ld:
            try:
                _ld_values(json.loads(text), dates, authors)
            except (ValueError, RecursionError):
                continue  # not JSON
        return dates, authors

    def result(self):
        self._flush()
        title = "".join(self.title_parts).strip() or "".join(self.h1_parts).strip() or None
        if self.has_article:
            pars = self.article_pars
        else:
            main = self._main()
            pars = [t for t, links, block in self.pars if links <= LINK_SHARE * len(t) and main.holds(block)]
        dates, names = self._linked_data()
        authors = []
        if self.meta.get("author"):
            authors += [x.strip() for x in re.split(r",| and ", self.meta["author"]) if x.strip()]
        authors += [x for x in names if x not in authors]
        authors += [x for x in self.authors_links if x not in authors]
        date = next((self.meta[k] for k in DATE_META if self.meta.get(k)), None) or next(iter(dates), None) or self.time_dt
        return (title, "\n\n".join(pars), authors, date, self.meta.get("og:description"),
                self.meta.get("twitter:description"), self.meta.get("description"), self.lang)


def parse_page(html: str | None) -> tuple:
    """One page -> the tuple of ``EXTRACT_FIELDS`` values (None fields when html is empty).

    A page that the parser gives up gets what was read of it, and the error.
    """
    if not html:
        return (None, "", [], None, None, None, None, None, None)
    p, error = _Page(), None
    try:
        p.feed(html)
        p.close()
    except (AssertionError, ValueError) as e:  # html.parser on malformed declarations
        error = f"{type(e).__name__}: {e}"
    return (*p.result(), error)


def parse_html(html: str | None) -> tuple:
    """``parse_page`` without the error."""
    return parse_page(html)[:-1]


#: Pages whose texts a task holds in Python at once.
PARSED_ROWS = 100


def extract_articles(df: DataFrame, html_col: str, keep_cols) -> DataFrame:
    """``keep_cols`` + ``EXTRACT_FIELDS`` for every row (mapInArrow, ``PARSED_ROWS`` pages at a time)."""
    keep = list(keep_cols)
    src = df.select(*keep, F.col(html_col).alias("_html"))
    in_fields = [f for f in src.schema.fields if f.name != "_html"]
    out_schema = T.StructType(in_fields + [T.StructField(n, t) for n, t in EXTRACT_FIELDS])
    names = [f.name for f in in_fields]

    def run(batches):
        for batch in (b.slice(k, PARSED_ROWS) for b in batches for k in range(0, b.num_rows, PARSED_ROWS)):
            htmls = batch.column("_html").to_pylist()
            parsed = [parse_page(h) for h in htmls]
            cols = [batch.column(n) for n in names]
            for i, (name, _) in enumerate(EXTRACT_FIELDS):
                vals = [p[i] for p in parsed]
                cols.append(pa.array(vals, type=pa.list_(pa.string()) if name == "authors_raw" else pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names + [n for n, _ in EXTRACT_FIELDS])

    return src.mapInArrow(run, out_schema)


def article_fields(extracted: DataFrame) -> DataFrame:
    """F1, F2, F5, P9, F6 on extracted fields (JVM): ``title, text, summary, authors, publish_date, meta_lang``."""
    parsed = F.try_to_timestamp(F.substring("date_raw", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return (extracted
            .withColumn("text", X.strip_title(X.collapse_newlines("text_raw"), "title"))
            .withColumn("summary", X.summary_cascade("og_description", "twitter_description", "description"))
            .withColumn("authors", X.keep_authors("authors_raw"))
            .withColumn("publish_date", format_publish_date(parsed))
            .drop("text_raw", "authors_raw", "date_raw", "og_description", "twitter_description", "description"))
