"""Boundary rows for the URL gate."""

from corpusflow.functions import url as U
from corpusflow.operators import url_gate as G

ALLOW = {"good.com": True, "listed.com": ["www", "news"], "empty.com": []}


def gate(spark, urls, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    out = G.url_gate(df, G.allow_list_df(spark, ALLOW), G.suffix_rules_df(spark), **kw)
    rows = {r["id"]: r for r in out.collect()}
    return [rows[i]["reject_reason"] for i in range(len(urls))], [rows[i] for i in range(len(urls))]


def test_length_boundary(spark):
    base = "http://good.com/"
    u200 = base + "a" * (200 - len(base))
    u201 = base + "a" * (201 - len(base))
    reasons, _ = gate(spark, [u200, u201])
    assert reasons == [None, "length"]


def test_domain_rules(spark):
    urls = ["http://x.y.good.com/a", "http://www.listed.com/a", "http://blog.listed.com/a",
            "http://empty.com/a", "http://www.empty.com/a", "http://unlisted.com/a", "http://listed.com/a"]
    reasons, _ = gate(spark, urls)
    assert reasons == [None, None, "domain", "domain", "domain", "domain", "domain"]


def test_extensions(spark):
    urls = ["http://good.com/a.png", "http://good.com/a.PNG", "http://good.com/.png",
            "http://good.com/b..png", "http://good.com/a.png?x=1", "http://good.com/dir.png/page",
            "http://good.com/a.html", "http://good.com/a.png;v=1"]
    reasons, _ = gate(spark, urls)
    assert reasons == ["extension", None, None, "extension", "extension", None, None, "extension"]


def test_extension_reference_mode_never_fires(spark):
    reasons, _ = gate(spark, ["http://good.com/a.png"], extension_mode="reference")
    assert reasons == [None]


def test_endings(spark):
    urls = ["http://good.com/a", "http://good.com/x.net/a", "http://good.com/a?u=b.org",
            "http://good.com/community"]
    reasons, _ = gate(spark, urls)
    assert reasons == [None, "endings", "endings", None]


def test_banned_literals(spark):
    urls = ["http://good.com/video/1", "http://good.com/a?width=3", "http://good.com/admin.asp?x",
            "http://good.com/adminXasp?x", "http://good.com/Video/1"]
    reasons, _ = gate(spark, urls)
    assert reasons == ["banned", "banned", "banned", None, None]


def test_clean_url_and_parts(spark):
    _, rows = gate(spark, ["HTTP://www.listed.com/a;p=1?q=2#f"])
    r = rows[0]
    assert r["clean_url"] == "http://www.listed.com/a;p=1"
    assert (r["subdomain"], r["domain"], r["suffix"]) == ("www", "listed", "com")


def test_public_suffix_rules(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.ck",), ("www.ck",), ("a.zz",)], "host string")
    parts = {r["host"]: r for r in G.split_hosts(hosts, G.suffix_rules_df(spark)).collect()}
    assert (parts["a.b.co.uk"]["subdomain"], parts["a.b.co.uk"]["domain"], parts["a.b.co.uk"]["suffix"]) == ("a", "b", "co.uk")
    assert (parts["co.uk"]["domain"], parts["co.uk"]["suffix"]) == ("", "co.uk")
    assert (parts["x.y.ck"]["domain"], parts["x.y.ck"]["suffix"]) == ("x", "y.ck")
    assert (parts["www.ck"]["domain"], parts["www.ck"]["suffix"]) == ("www", "ck")
    assert parts["a.zz"]["suffix"] is None


def test_banned_regex_escapes():
    assert U.escape_literal("admin.asp?") == r"admin\.asp\?"


def test_long_lists_are_joined_with_the_same_result(spark, monkeypatch):
    """A rule list and an allow list beyond the literals' bound: joins, equal rows."""
    rules = G.suffix_rules_df(spark).unionByName(spark.createDataFrame(
        [("ck", "wildcard"), ("www.ck", "exception"), ("kobe.jp", "wildcard"), ("city.kobe.jp", "exception"), ("uk", "plain"), ("co.uk", "plain")], "name string, kind string"))
    urls = ["http://a.b.co.uk/x", "http://co.uk/", "http://www.ck/", "http://x.y.ck/a", "http://y.ck", "http://city.kobe.jp/", "http://a.c.kobe.jp/", "http://c.kobe.jp/",
            "http://news.good.com/1", "http://good.com/1", "http://shop.good.com/1", "http://other.com/1", "http://nosuffix/", "not a url", "", None, "http://good.com/" + "x" * 300]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k long, url string")
    allow = G.allow_list_df(spark, {"good.com": ["news", ""], "b.co.uk": True, "www.ck": True, "x.y.ck": True})

    def run():
        return sorted(map(tuple, G.url_gate(df, allow, rules).select("k", "host", "subdomain", "domain", "suffix", "registered_domain", "reject_reason", "clean_url").collect()))

    short = run()
    monkeypatch.setattr(G, "LITERALS", 0)
    assert run() == short and any(r[6] is None for r in short)


def test_a_full_size_rule_list(spark):
    rules = spark.range(12_000).selectExpr("concat('s', id, '.com') as name", "'plain' as kind").unionByName(
        spark.createDataFrame([("com", "plain")], "name string, kind string"))
    hosts = spark.createDataFrame([("a.b.s77.com",), ("x.s12001.com",), ("s5.com",)], "host string")
    got = {r.host: (r.subdomain, r.domain, r.suffix) for r in G.split_hosts(hosts, rules).collect()}
    assert got == {"a.b.s77.com": ("a", "b", "s77.com"), "x.s12001.com": ("x", "s12001", "com"), "s5.com": ("", "", "s5.com")}
