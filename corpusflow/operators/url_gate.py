"""The URL gate of the archive ingest.

Checks, in order (the first failure names the reject reason):

``length``    URL longer than 200 characters;
``domain``    registered domain (``domain.suffix``) absent from the allow list,
              or listed with a subdomain list that lacks this subdomain
              (an empty list rejects all, ``true`` accepts all);
``extension`` banned extension of the path (query/fragment/params cut off);
``endings``   more than one of ``.com .co.uk .net .org`` anywhere in the URL;
``banned``    a banned substring anywhere in the URL.

J1 (host -> longest public suffix) is an expression over the row: every
candidate suffix of the host is looked up in the rule names (plain, wildcard,
exception), which are literals of the job, and so is the allow list.  The gate
therefore joins and shuffles nothing, whatever the rows carry besides the URL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions import url as U

# Fixed values of the URL gate (reference): banned extensions, in the order given there.
BANNED_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "php", "css", "ico", "xml", "woff", "swf", "jpg", "svg", "ttf", "tif",
    "bmp", "js", "pdf", "amp", "rss", "mp3", "eot", "jsp", "woff2", "json", "com", "axd", "php3",
    "bin", "mp4", "img", "xhtml", "dll", "m4v", "vov", "phtml", "flv", "pl", "jpe", "otf", "php'",
    "wmv", "wav", "xls", "doc", "photo", "gallery", "bg", "ece", "feed", "xmlhttp", "video", "eml",
    "xnf", "prt", "docx", "file", "vpx", "cur", "data", "jhtml", "xlsx", "map", "fb", "webp", "ppt",
    "rdf", "bio", "exe", "jar", "net", "open", "ogg", "wma", "7u", "res", "dwr", "pjpeg", "gz", "ajax",
    "psd", "zip", "coffee", "tabs", "cls", "step", "jp",
]

# Fixed values of the URL gate (reference): banned substrings, in the order given there.
BANNED_STRINGS = [
    "slideshow.",
    "slideshowImage", "associatedcontent.com",
    "/videoid/", "sodahead.com", "b92.net",
    "isna.ir", "prnewswire.com", "slashdot.org", "suite101.com", "tv.com", "news.yahoo.com",
    "/video/", "/image/", "bbb.org", "yle.fi", "ImageId", "slideshow_files", "/slideshows/",
    "/videos/", "/video-", "/videoid/", "/wp-json/", "/search/", "videoID=", "/portableplayer/",
    "video.aspx", "/allvideo/", "width=", "height=", "/PhotoGallery/", "ArticleSlideshowServlet",
    "/storyimage/", "/image.html", "/photos/", ".jpeg", ".jpg", "/em_image", "maxw=", "maxh=",
    "/flashplayers/", "/apps/", "/gallery/", "photogallery", "imageViewer", ".jpg", "img=",
    "/forums/", "/users/", "/tags/", "/audio/", "/resources/", "/metrics/", "/images/", "/products/",
    "com.pe", "/agencia/", "/resizer/", "/user?", "/tag/", "/bookmark/", "/plugins/", "/blogs/",
    "/advertising/", "blockbuster.co.uk", "/oembed/", "/needlogin", "type=login", "/mailto/", "/feed",
    "sendtofriend.aspx", "/ajax/", "bloggernews.net", "/topics/", "view_gallery", "/event.asp", "/forum/",
    "/posts/", "/cgi-bin/", "/member/", "news_tool_v2.cfm", "/database/", "/Default.aspx",
    "/Search/", "/Slideshow/", "/slideshow/", "/user/", "/register/", "/donate/", "/calendar/",
    "send-to-friend",
    "/enter/", "/photo-gallery/", "/news_email.asp", "/Flash.aspx", "/findlocal/", "/ads/", "/reply/",
    "/events/", "/picture-gallery/", "/slideshow?", "/Mozilla/", "/sendtoafriend.asp", "/blog/",
    "/mailStory/", "admin.asp?", ".ads/", "/used_cars/",
]

BANNED_RE = U.literal_alternation(BANNED_STRINGS)

# A small built-in public-suffix rule set (ours).  Real deployments load the
# full list with ``read_public_suffix_list``.
DEFAULT_SUFFIX_RULES = """
com
net
org
edu
gov
io
de
fr
es
fi
ir
pe
com.pe
uk
co.uk
org.uk
ac.uk
ca
au
com.au
*.ck
!www.ck
"""

SUFFIX_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())])
ALLOW_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("all_subdomains", T.BooleanType()),
    T.StructField("subdomains", T.ArrayType(T.StringType())),
])


def parse_suffix_rule(line: str):
    line = line.strip().split()[0] if line.strip() else ""
    if not line or line.startswith("//"):
        return None
    if line.startswith("!"):
        return (line[1:].lower(), "exception")
    if line.startswith("*."):
        return (line[2:].lower(), "wildcard")
    return (line.lower(), "plain")


def suffix_rules_df(spark: SparkSession, text: str = DEFAULT_SUFFIX_RULES) -> DataFrame:
    rows = [r for r in (parse_suffix_rule(x) for x in text.splitlines()) if r]
    return spark.createDataFrame(rows, SUFFIX_SCHEMA)


def read_public_suffix_list(spark: SparkSession, path: str) -> DataFrame:
    """Public-suffix list file (one rule per line, ``//`` comments) -> ``name, kind``."""
    raw = spark.read.text(path).select(F.trim(F.split(F.col("value"), r"\s")[0]).alias("r"))
    raw = raw.where((F.length("r") > 0) & ~F.col("r").startswith("//"))
    return raw.select(
        F.lower(F.regexp_replace("r", r"^(!|\*\.)", "")).alias("name"),
        F.when(F.col("r").startswith("!"), "exception")
         .when(F.col("r").startswith("*."), "wildcard").otherwise("plain").alias("kind"))


def allow_list_df(spark: SparkSession, mapping: Mapping[str, object]) -> DataFrame:
    """Allow list from ``{domain: True | [subdomain, ...]}`` (the JSON file's shape)."""
    rows = []
    for dom, val in mapping.items():
        if val is True:
            rows.append((dom, True, None))
        elif isinstance(val, (list, tuple)):
            rows.append((dom, False, list(val)))
    return spark.createDataFrame(rows, ALLOW_SCHEMA)


def read_allow_list(spark: SparkSession, path: str) -> DataFrame:
    """Allow-list JSON object file ``{"domain": true | ["sub", ...]}`` -> ``ALLOW_SCHEMA`` rows."""
    raw = spark.read.option("wholetext", True).text(path)
    entries = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("domain", "v"))
    return entries.select(
        "domain",
        (F.trim("v") == "true").alias("all_subdomains"),
        F.when(F.trim("v").startswith("["), F.from_json("v", "array<string>")).alias("subdomains"))


#: Names of a rule or allow list that become literals of the plan; longer lists are joined.
LITERALS = 50_000


def suffix_sets(rules: DataFrame) -> dict[str, list[str]]:
    """Rule names by kind, at most ``LITERALS`` (the caller has counted them)."""
    out: dict[str, list[str]] = {"plain": [], "wildcard": [], "exception": []}
    for r in rules.select("name", "kind").distinct().collect():
        out[r["kind"]].append(r["name"])
    return out


def _is_in(c: Column, names: list[str]) -> Column:
    """Membership in a set of literals (Spark probes long lists through a hash set)."""
    return F.coalesce(c.isin(names), F.lit(False)) if names else F.lit(False)


def _parts_of(labels: Column, n: Column, k: Column) -> Column:
    """``subdomain, domain, suffix`` of ``n`` labels whose last ``k`` are the suffix; null without a suffix."""
    return F.when(k > 0, F.struct(
        F.array_join(F.slice(labels, 1, F.greatest(n - k - 1, F.lit(0))), ".").alias("subdomain"),
        F.when(n > k, F.get(labels, n - k - 1)).otherwise("").alias("domain"),
        F.array_join(F.slice(labels, n - k + 1, F.greatest(k, F.lit(0))), ".").alias("suffix")))


def joined_host_parts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, _parts`` as ``host_parts`` gives them, by a join of each host's endings with a rule list of any length."""
    labels = F.split("host", r"\.")
    ends = (hosts.where("host <> ''").select("host", labels.alias("l")).withColumn("n", F.size("l"))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))))
    name = lambda i: F.array_join(F.slice("l", i + 1, F.greatest(F.col("n") - i, F.lit(1))), ".")
    left = F.col("n") - F.col("i")
    tried = ends.select("host", F.explode(F.array(
        F.struct(name(F.col("i")).alias("name"), F.lit("exception").alias("kind"), (left - 1 + 1_000_000).alias("score")),
        F.struct(name(F.col("i")).alias("name"), F.lit("plain").alias("kind"), left.alias("score")),
        F.struct(F.when(left > 1, name(F.col("i") + 1)).alias("name"), F.lit("wildcard").alias("kind"), left.alias("score")))).alias("t")).select("host", "t.*")
    best = (tried.join(rules.select("name", "kind").distinct(), ["name", "kind"])
            .groupBy("host").agg((F.max("score") % 1_000_000).cast("int").alias("k")))
    return best.withColumn("l", labels).select("host", _parts_of(F.col("l"), F.size("l"), F.col("k")).alias("_parts"))


def host_parts(host: Column, rules: DataFrame) -> Column:
    """J1 of one host as a struct ``subdomain, domain, suffix``; null if no rule matches.

    Prevailing rule: an exception rule if one matches (its suffix is the rule
    minus its first label), else the matching rule with the most labels.  All
    of it is an expression over the row: no join, no shuffle, and a host with a
    third of all rows costs nothing extra.
    """
    sets = suffix_sets(rules)

    def split(labels: Column) -> Column:
        n = F.size(labels)

        def score(i: Column) -> Column:
            """Labels in the suffix under a rule that starts at label i; exceptions go before all others."""
            here = F.array_join(F.slice(labels, i + 1, n - i), ".")
            below = F.when(i < n - 1, F.array_join(F.slice(labels, i + 2, F.greatest(n - i - 1, F.lit(1))), "."))
            return (F.when(_is_in(here, sets["exception"]), n - i - 1 + 1_000_000)
                    .when(_is_in(below, sets["wildcard"]) | _is_in(here, sets["plain"]), n - i).otherwise(0))

        best = F.array_max(F.transform(F.sequence(F.lit(0), n - 1), score)) % 1_000_000

        def parts(k: Column) -> Column:
            return _parts_of(labels, n, k)

        return F.get(F.transform(F.array(best), parts), 0)

    # labels and the best rule are bound to lambda variables, so each is evaluated once
    return F.when(host != "", F.get(F.transform(F.array(F.split(host, r"\.")), split), 0))


def split_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """J1 / F4 on a table of ``host``: ``host, subdomain, domain, suffix`` (nulls: no rule matched)."""
    if rules.count() > LITERALS:
        return hosts.join(joined_host_parts(hosts.distinct(), rules), "host", "left").select("host", "_parts.*")
    return hosts.select("host", host_parts(F.col("host"), rules).alias("p")).select("host", "p.*")


def url_parts(df: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host, subdomain, domain, suffix, registered_domain`` to ``df`` (nulls: no rule matched)."""
    out = df.withColumn("host", U.host(url_col))
    if rules.count() > LITERALS:
        out = out.join(joined_host_parts(out.select("host").distinct(), rules), "host", "left")
    else:
        out = out.withColumn("_parts", host_parts(F.col("host"), rules))
    for c in ("subdomain", "domain", "suffix"):
        out = out.withColumn(c, F.col(f"_parts.{c}"))
    return out.drop("_parts").withColumn(
        "registered_domain",
        F.when(F.col("suffix").isNotNull(), F.concat_ws(".", "domain", "suffix")))


def url_gate(df: DataFrame, allow: DataFrame, rules: DataFrame, url_col: str = "url",
             extension_mode: str = "intended") -> DataFrame:
    """All rows of ``df`` plus ``clean_url``, URL parts and ``reject_reason`` (null = accepted).

    ``extension_mode="reference"`` reproduces the reference, whose extension
    test compares the dotted extension with undotted names and never fires.
    """
    parts = url_parts(df, rules, url_col)
    names = allow.agg(F.sum(F.greatest(F.lit(1), F.size(F.coalesce("subdomains", F.array().cast("array<string>")))))).first()[0] or 0
    if names > LITERALS:
        known = allow.groupBy(F.col("domain").alias("registered_domain")).agg(
            F.max(F.coalesce("all_subdomains", F.lit(False))).alias("_open"), F.flatten(F.collect_list("subdomains")).alias("_subs"))
        x = parts.join(known, "registered_domain", "left").select(
            *parts.columns, (F.col("_open") | F.coalesce(F.array_contains("_subs", F.col("subdomain")), F.lit(False))).alias("_allowed"))
        allowed = F.col("_allowed")
    else:
        entries = allow.select("domain", "all_subdomains", "subdomains").collect()  # LITERALS names at most
        open_ = [r["domain"] for r in entries if r["all_subdomains"]]
        pairs = [f"{sub} {r['domain']}" for r in entries for sub in r["subdomains"] or []]
        x = parts
        allowed = _is_in(F.col("registered_domain"), open_) | _is_in(F.concat_ws(" ", "subdomain", "registered_domain"), pairs)
    ext_banned = F.lit(False) if extension_mode == "reference" else \
        U.extension(url_col).isin(BANNED_EXTENSIONS)
    reason = (F.when(F.length(url_col) > U.MAX_URL_LENGTH, "length")
              .when(F.col("registered_domain").isNull() | ~F.coalesce(allowed, F.lit(False)), "domain")
              .when(ext_banned, "extension")
              .when(U.endings_count(url_col) > 1, "endings")
              .when(F.col(url_col).rlike(BANNED_RE), "banned"))
    return (x.withColumn("reject_reason", reason).drop("_allowed")
            .withColumn("clean_url", U.clean_url(url_col)))
