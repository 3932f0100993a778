"""URL gate queries over ``pages`` (P1-P5, J1, F3, F4) and page title/language (regex form of X1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions import html as H
from corpusflow.functions import url as U
from corpusflow.operators import url_gate as G
from corpusflow.plans.registry import register
from corpusflow.plans.sqlgen import in_list, s, str_list
from corpusflow.sources.tables import table

# Allow list used for the test pages (a parameter, like the reference's JSON
# file): one domain open to all subdomains, one with a subdomain list, one
# with an empty list (rejects all).
PAGES_ALLOW = {
    "example.com": True,
    "example.net": ["blog.tionsh", "m.ththth", "therin", "www"],
    "example.org": [],
}


def _rules_sql() -> str:
    rows = [G.parse_suffix_rule(x) for x in G.DEFAULT_SUFFIX_RULES.splitlines()]
    return "rules(name, kind) AS (VALUES " + ", ".join(f"({s(n)}, {s(k)})" for n, k in (r for r in rows if r)) + ")"


def _allow_sql() -> str:
    vals = []
    for dom, v in PAGES_ALLOW.items():
        if v is True:
            vals.append(f"({s(dom)}, true, CAST(NULL AS VARCHAR[]))")
        else:
            vals.append(f"({s(dom)}, false, {str_list(v)})")
    return "allow(domain, all_subdomains, subdomains) AS (VALUES " + ", ".join(vals) + ")"


_PARTS_SQL = f"""{_rules_sql()},
{_allow_sql()},
p AS (SELECT page_id, url, lower(regexp_extract(url, {s(U.HOST_RE)}, 1)) AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
lab AS (SELECT host, string_split(host, '.') AS labels, len(string_split(host, '.')) AS n FROM hosts),
ci AS (SELECT host, n, labels, unnest(range(n)) AS i FROM lab),
cands AS (SELECT host, n, i, array_to_string(labels[i + 1:], '.') AS cand,
                 CASE WHEN i < n - 1 THEN array_to_string(labels[i + 2:], '.') END AS tail FROM ci),
m AS (SELECT c.host, CASE WHEN r.kind = 'exception' THEN 1 ELSE 0 END AS exc,
             CASE WHEN r.kind = 'exception' THEN c.n - c.i - 1 ELSE c.n - c.i END AS nl
      FROM cands c JOIN rules r
        ON (r.kind <> 'wildcard' AND r.name = c.cand) OR (r.kind = 'wildcard' AND r.name = c.tail)),
best AS (SELECT host, max(exc * 1000000 + nl) % 1000000 AS nl FROM m GROUP BY host),
parts AS (
  SELECT l.host,
    CASE WHEN b.nl > 0 THEN array_to_string(l.labels[1:greatest(l.n - b.nl - 1, 0)], '.') END AS subdomain,
    CASE WHEN b.nl > 0 THEN CASE WHEN l.n > b.nl THEN l.labels[l.n - b.nl] ELSE '' END END AS domain,
    CASE WHEN b.nl > 0 THEN array_to_string(l.labels[l.n - b.nl + 1:], '.') END AS suffix
  FROM lab l LEFT JOIN best b USING (host)),
split AS (
  SELECT p.page_id, p.url, p.host, parts.subdomain, parts.domain, parts.suffix,
         CASE WHEN parts.suffix IS NOT NULL THEN parts.domain || '.' || parts.suffix END AS registered_domain
  FROM p LEFT JOIN parts USING (host)),
nq AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS nq FROM split),
gated AS (
  SELECT nq.*,
    lower(regexp_extract(nq, {s(U.SCHEME_RE)}, 0)) || substr(nq, length(regexp_extract(nq, {s(U.SCHEME_RE)}, 0)) + 1) AS clean_url,
    regexp_extract(url, {s(U.PATH_RE)}, 1) AS path,
    regexp_extract(regexp_replace(regexp_extract(url, {s(U.PATH_RE)}, 1), {s(U.PARAMS_RE)}, ''), {s(U.EXT_RE)}, 1) AS extension,
    CASE
      WHEN length(url) > {U.MAX_URL_LENGTH} THEN 'length'
      WHEN registered_domain IS NULL
        OR NOT coalesce(a.all_subdomains OR coalesce(list_contains(a.subdomains, nq.subdomain), false), false) THEN 'domain'
      WHEN regexp_extract(regexp_replace(regexp_extract(url, {s(U.PATH_RE)}, 1), {s(U.PARAMS_RE)}, ''), {s(U.EXT_RE)}, 1)
           IN {in_list(G.BANNED_EXTENSIONS)} THEN 'extension'
      WHEN len(regexp_extract_all(url, {s(U.ENDINGS_RE)})) > 1 THEN 'endings'
      WHEN regexp_matches(url, {s(G.BANNED_RE)}) THEN 'banned'
    END AS reject_reason
  FROM nq LEFT JOIN allow a ON a.domain = nq.registered_domain)"""


def _gated(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return G.url_gate(pages, G.allow_list_df(spark, PAGES_ALLOW), G.suffix_rules_df(spark))


@register("url_gate", f"WITH {_PARTS_SQL} SELECT page_id, clean_url, registered_domain FROM gated WHERE reject_reason IS NULL")
def url_gate(spark, sf_dir):
    """Accepted pages with their clean URL and registered domain."""
    return _gated(spark, sf_dir).where(F.col("reject_reason").isNull()) \
        .select("page_id", "clean_url", "registered_domain")


@register("url_reject_funnel", f"""WITH {_PARTS_SQL}
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1""")
def url_reject_funnel(spark, sf_dir):
    """A4 for the URL gate: pages per first failed check."""
    return _gated(spark, sf_dir).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")) \
        .agg(F.count(F.lit(1)).alias("n"))


@register("url_clean", f"WITH {_PARTS_SQL} SELECT page_id, clean_url, host, path, extension FROM gated")
def url_clean(spark, sf_dir):
    """Clean URL, host, path and extension of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select("page_id", U.clean_url("url").alias("clean_url"), U.host("url").alias("host"),
                        U.path("url").alias("path"), U.extension("url").alias("extension"))


@register("url_domain_split", f"""WITH {_PARTS_SQL}
SELECT page_id, host, subdomain, domain, suffix, registered_domain FROM split""")
def url_domain_split(spark, sf_dir):
    """Longest public suffix of each page's host, as an expression over the row while the rule list is short."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return G.url_parts(pages, G.suffix_rules_df(spark)) \
        .select("page_id", "host", "subdomain", "domain", "suffix", "registered_domain")


@register("page_title_lang", f"""SELECT page_id,
  {H.unescape_sql(f"trim(regexp_extract(html, {s(H.TITLE_RE)}, 1))")} AS title,
  regexp_extract(html, {s(H.LANG_RE)}, 1) AS lang,
  length({H.unescape_sql(f"trim(regexp_extract(html, {s(H.TITLE_RE)}, 1))")}) AS title_chars
FROM pages""")
def page_title_lang(spark, sf_dir):
    """Title (``<title>``, entities decoded) and ``<html lang>`` of every page, JVM-side."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    title = H.unescape(F.trim(F.regexp_extract("html", H.TITLE_RE, 1)))
    return pages.select("page_id", title.alias("title"),
                        F.regexp_extract("html", H.LANG_RE, 1).alias("lang"),
                        F.length(title).cast("long").alias("title_chars"))


def _page_articles(spark, sf_dir):
    from corpusflow.operators import crawl

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return crawl.page_articles(pages, G.allow_list_df(spark, PAGES_ALLOW), G.suffix_rules_df(spark))


@register("page_quality_funnel")
def page_quality_funnel(spark, sf_dir):
    """X1 + P8 + A4: URL gate, HTML extraction (Arrow batches) and quality gate; pages per first failure.

    The test pages carry no publish date, so every page that passes the URL
    gate stops at ``date``; the gate's other reasons are covered by tests.
    """
    from corpusflow.operators import quality as Q
    return Q.funnel(_page_articles(spark, sf_dir))


@register("page_articles")
def page_articles(spark, sf_dir):
    """X1 output for URL-accepted pages: title, language, text and summary sizes, author count."""
    a = _page_articles(spark, sf_dir).where(F.col("reject_reason").isNull() | ~F.col("reject_reason").isin("length", "domain", "extension", "endings", "banned"))
    return a.select("page_id", "title", "meta_lang", F.length("text").cast("long").alias("text_chars"),
                    F.size("authors").cast("long").alias("n_authors"), "summary", "reject_reason")


# Stand-in crawl manifest: one archive path per page (month and segment are fixed text; the file is the page).
_MONTH = "CC-MAIN-2024-10"


def _manifest_lines(pages):
    return pages.select(F.concat(F.lit(f"crawl-data/{_MONTH}/segments/0/warc/p"), F.col("page_id").cast("string"),
                                 F.lit(".warc.gz")).alias("value"))


@register("resume_archives", f"""WITH {_PARTS_SQL},
man AS (SELECT 'crawl-data/{_MONTH}/segments/0/warc/p' || CAST(page_id AS VARCHAR) || '.warc.gz' AS path, page_id
        FROM pages),
keyed AS (SELECT path, page_id, split_part(path, '/', 2) AS month,
                 split_part(path, '/', 2) || '/' || array_to_string(string_split(path, '/')[3:], '_') || '.jsonl' AS out_key
          FROM man),
done AS (SELECT k.out_key FROM keyed k JOIN gated g USING (page_id) WHERE g.reject_reason IS NULL)
SELECT path, month, out_key FROM keyed WHERE out_key NOT IN (SELECT out_key FROM done)""")
def resume_archives(spark, sf_dir):
    """S2 + J4: manifest lines -> (month, output key); archives whose output already exists are skipped.

    Stand-in: one archive per page, and the previous run's outputs are those of
    the pages the URL gate accepted.
    """
    from corpusflow.sources import files

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    manifest = files.manifest_keys(_manifest_lines(pages))
    accepted = _gated(spark, sf_dir).where(F.col("reject_reason").isNull()).select("page_id")
    done = files.manifest_keys(_manifest_lines(pages.join(accepted, "page_id", "left_semi"))).select("out_key")
    return files.pending_archives(manifest, done).select("path", "month", "out_key")


def _write_archives(pages, path: str) -> None:
    """Stand-in archives: one response record per page, gzip files of some 500 records."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), F.coalesce("html", F.lit("")))
    record = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.col("url"),
                      F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response"
                            "\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"), http)
    (pages.where(F.col("url").isNotNull()).select(record.alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", 500).option("compression", "gzip").text(path))


@register("archive_articles", f"""WITH {_PARTS_SQL}
SELECT g.clean_url, g.registered_domain,
       CASE WHEN g.reject_reason IS NOT NULL THEN g.reject_reason
            WHEN coalesce(p.html, '') = '' THEN 'parse' ELSE 'date' END AS reject_reason
FROM gated g JOIN pages p USING (page_id) WHERE g.url IS NOT NULL""")
def archive_articles(spark, sf_dir):
    """S1 -> P6 -> URL gate -> P7 -> X1 -> P8: archives read record by record, each with its first failed check.

    The test pages carry no publish date, so what passes the URL gate stops at ``date``.
    """
    import uuid

    from corpusflow.operators import crawl
    from corpusflow.session import ensure_checkpoint_dir
    from corpusflow.sources import warc

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/crawl-{uuid.uuid4().hex}"
    _write_archives(table(spark, sf_dir, "pages").select("url", "html"), path)
    records = warc.read_warc(spark, path, "part-*")
    articles = crawl.records_to_articles(records.where(F.col("error").isNull()).drop("error"),
                                         G.allow_list_df(spark, PAGES_ALLOW), G.suffix_rules_df(spark))
    return articles.select("clean_url", "registered_domain", "reject_reason")


# Stand-in crawl links: every page's address without its query, as it is and with an ending that one URL rule is about.
_ENDINGS = ["", f"/file.{G.BANNED_EXTENSIONS[0]}", "/www.a.com/b.org", f"/{G.BANNED_STRINGS[0]}html", "/" + "long" * 50]


@register("url_rule_funnel", f"""WITH {_PARTS_SQL.replace("FROM pages)", """FROM (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') || e AS url FROM pages, (VALUES """ + ", ".join(f"({s(e)})" for e in _ENDINGS) + """) t(e)))""")}
SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1""")
def url_rule_funnel(spark, sf_dir):
    """P1-P5 / A4 over links of every kind: each rule of the URL gate decides some of them."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("base"))
    links = pages.select("page_id", F.explode(F.array(*[F.concat("base", F.lit(e)) for e in _ENDINGS])).alias("url"))
    gated = G.url_gate(links, G.allow_list_df(spark, PAGES_ALLOW), G.suffix_rules_df(spark))
    return gated.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
