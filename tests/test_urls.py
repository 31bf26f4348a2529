"""URL cleaning against tables of expected results."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlnet.functions import hashing, suffixes, urls
from trawlnet.operators import clean

H = "http://site.org"
NORMAL = [
    (f"  {H}/ \t", f"{H}/"), ("HTTPS://site.org/a", "https://site.org/a"), (f"{H}:80/a.html", f"{H}/a.html"), ("https://site.org:443/", "https://site.org/"), (f"{H}:8081/", f"{H}:8081/"), ("https://site.org:80/", "https://site.org:80/"),
    (H, f"{H}/"), (f"{H}?", f"{H}/"), (f"{H}?a=1", f"{H}/?a=1"), (f"{H}//b", f"{H}/b"), (f"{H}////b//c/", f"{H}/b/c/"), (f"{H}/b#part", f"{H}/b"), (f"{H}/#part", f"{H}/"), (f"{H}/b?x=1#part", f"{H}/b?x=1"),
    ("http://SITE.Org/B", f"{H}/B"), ("http://site.org./b", f"{H}/b"), ("http://site.org.:8080", f"{H}:8080/"), ("site.org/", f"{H}/"), ("site.org", f"{H}/"), ("mailto://a@site.org", "mailto://a@site.org"), ("gopher://site.org/%61", "gopher://site.org/%61"), ("ftp://site.org/%61", "ftp://site.org/%61"),
    (f"{H}/%61b.html", f"{H}/ab.html"), (f"{H}/b?x=%61b", f"{H}/b?x=ab"), (f"{H}/b?", f"{H}/b"), (f"{H}/b?x=", f"{H}/b?x="), (f"{H}/b?x", f"{H}/b?x"), (f"{H}/b?&x&&y=&z=1&", f"{H}/b?x&y=&z=1"), (f"{H}/a%20b", f"{H}/a+b"), (f"{H}/a b", f"{H}/a+b"), (f"{H}/a+b", f"{H}/a+b"),
    (f"{H}/a%3Fb", f"{H}/a%3fb"), (f"{H}/a%2Fb", f"{H}/a%2fb"), (f"{H}/?x=a%2Fb", f"{H}/?x=a/b"), (f"{H}/100%", f"{H}/100%25"), (f"{H}/a%zz", f"{H}/a%25zz"), (f"{H}/ü", f"{H}/%c3%bc"), (f"{H}/<b>", f"{H}/%3cb%3e"), (f"{H}/a;b", f"{H}/a;b"), (f"{H}/?x=a;b:c", f"{H}/?x=a%3bb%3ac"),
    (f"{H}/a/../", f"{H}/"), (f"{H}/a/b/../", f"{H}/a/"), (f"{H}/a/..", f"{H}/a/.."), (f"{H}/a/b/c/../../d", f"{H}/a/d"), (f"{H}/../../d", f"{H}/d"), (f"{H}/a/../../d", f"{H}/d"), (f"{H}/a..b/c", f"{H}/a..b/c"), (f"{H}/a..b/../c", f"{H}/c"), (f"{H}/a.b/../c", f"{H}/c"), (f"{H}/a/../b/../c/../../", f"{H}/"),
    (f"{H}/p?PHPSESSID=12ab", f"{H}/p"), (f"{H}/p?f=2&sid=9&q=3", f"{H}/p?f=2&q=3"), (f"{H}/p?Session_Id=1&q=3", f"{H}/p?q=3"), (f"{H}/p?x=1&-session=2", f"{H}/p?x=1"), (f"{H}/p;jsessionid=1F?x=1", f"{H}/p?x=1"), (f"{H}/p?x=1;jsessionid=1F", f"{H}/p?x=1"), (f"{H}/p?sid=1&phpsessid=2", f"{H}/p?phpsessid=2"),
    (f"{H}/p?country=fr", f"{H}/p"), (f"{H}/p?format=a&x=1", f"{H}/p?x=1"), (f"{H}/p?x=1&SortBy=2&y=3", f"{H}/p?x=1&y=3"), (f"{H}/p?user_id=7", f"{H}/p?user_id=7"), (f"{H}/p?width=1&height=2", f"{H}/p?height=2"),
    *[(f"{H}/a/{name}", f"{H}/a/") for name in ("index.html", "index.htm", "default.asp", "index.aspx", "INDEX.PhP", "Default.php5", "index.jsp", "index.jsf", "index.jspx", "index.jspa", "index.cfm", "index.cgi", "index.phtml", "index.shtml")],
    *[(f"{H}/a/{name}", f"{H}/a/{name}") for name in ("main.html", "index.jspfx", "index.jsps", "index.txt", "myindex.html", "index.php7")],
    (f"{H}/index.html?x=1", f"{H}/?x=1"), ("http://10.1.2.3/a?q=b", "http://10.1.2.3/a?q=b"), (f"{H}/f?m=7==&l=e", f"{H}/f?m=7==&l=e"), (f"{H}/f?m=7=a=&l=e", f"{H}/f?m=7=a=&l=e"), ("http://user:pw@site.org/a", f"{H}/a"), ("http://site.org:port/a", "http://site.org:port/a"), ("", "http:///"),
]


@pytest.mark.parametrize(("raw", "expected"), NORMAL)
def test_normalize(raw, expected):
    assert urls.normalize(raw) == expected


def test_normalize_settings():
    assert urls.normalize(f"{H}/p?x=1&user_id=7&y=2", aggressive=True) == f"{H}/p?x=1&y=2"
    assert urls.normalize(f"{H}/t/#url=http%3A//b.org/c%3Fd%3D1", ref_as_query=True) == f"{H}/t/#url=http%3a//b.org/c%3fd%3d1"
    assert urls.normalize(f"{H}/t/?q=1#r", ref_as_query=True) == f"{H}/t/?q=1"
    assert urls.normalize(f"{H}/t#r", ref_as_query=True) == f"{H}/t"


def test_normalized_column_is_the_function(spark):
    rows = spark.createDataFrame([(r,) for r, _ in NORMAL] + [(None,)], "url string").select("url", urls.normalized(F.col("url")).alias("n")).collect()
    assert all(r.n == (None if r.url is None else urls.normalize(r.url)) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ0.-_~/%&=?#:;+ü<", max_size=40))
def test_a_normal_path_stays(tail):
    once = urls.normalize(f"{H}/{tail}")
    clean = re.fullmatch(urls._CLEAN.replace("$", r"\Z"), once) and not re.search(urls._DEFAULT, once)
    assert not clean or urls.normalize(once) == once


VALID = [("http://a.com", True), ("https://www.a.com/x?y#z", True), ("http://a.com:8080/", True), ("http://1.2.3.4/", True), ("http://a.com/%3Cx%3E", True), ("http://u@a.com/", True), ("http://a.com/é", True), ("a.com", False), ("ftp://a.com/", False), ("mailto:a@b.com", False), ("HTTP://a.com/", False), ("javascript:x()", False), ("ttp://a.com", False),
         ("http://", False), ("http:///x", False), ("http://a.com/<x>", False), ("http://a.com/a b", False), ("http://a.com/%zz", False), ("http://a_b.com/", False), ("http://a.com/[x]", False), ("http://a.com/#a#b", False), ("", False), ("http://-a.com", False), ("http://a.com/" + "x" * 20_000, True)]


def test_validity(spark):
    rows = spark.createDataFrame(VALID + [(None, False)], "url string, want boolean").select("url", "want", urls.is_valid(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in rows if r.got != r.want] == []
    ends = spark.createDataFrame([("http://a.com/b.pdf", False), ("http://a.com/b.html", True), ("http://a.com/xpdf", True)], "url string, want boolean")
    assert all(r.got == r.want for r in ends.select("want", urls.is_valid(F.col("url"), ("pdf", "xml")).alias("got")).collect())


def test_keys(spark):
    rows = [
        ("http://x.y.dom.com/p", "dom.com", "http://x.y.dom.com", "com,dom,y,x)/p"), ("http://w.dom.co.jp:80/", "dom.co.jp", "http://w.dom.co.jp", "jp,co,dom,w:80)/"), ("https://1.2.3.4:8443", "1.2.3.4", "https://1.2.3.4:8443", "4,3,2,1:8443)/"), ("http://co.uk/", "co.uk", "http://co.uk", "uk,co)/"),
        ("http://a.b.ck/", "a.b.ck", "http://a.b.ck", "ck,b,a)/"), ("http://host.local/", "host.local", "http://host.local", "local,host)/"), ("https://www.dom.com:443/A/B/?b=2&A=1", "dom.com", "https://www.dom.com", "com,dom:443)/a/b?a=1&b=2"), ("http://www3.dom.com?q=X#Ref", "dom.com", "http://www3.dom.com", "com,dom)/?q=x#Ref"),
    ]
    u = F.col("url")
    got = spark.createDataFrame(rows, "url string, pld string, origin string, key string").select("*", urls.pld(u).alias("p"), urls.origin(u).alias("o"), urls.archive_key(u).alias("k")).collect()
    for r in got:
        assert (r.p, r.o, r.k) == (r.pld, r.origin, r.key)


def test_within_a_domain(spark):
    rows = [("http://dom.com/", True), ("http://a.Dom.com/", True), ("http://notdom.com/", False), ("http://dom.com.org/", False), ("ftp://dom.com/", False)]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "url string, want boolean").select("want", urls.is_within(F.col("url"), "DOM.com").alias("got")).collect())


def test_links_resolve(spark):
    rows = [("/a", "http://h.com/x/y?z", "http://h.com/a"), ("b", "http://h.com/x/y", "http://h.com/x/b"), ("//c.com/d", "https://h.com/", "https://c.com/d"), ("?q", "http://h.com", "http://h.com/?q"), ("#f", "http://h.com/x#g", "http://h.com/x#f"), ("mailto:a@b", "http://h.com/", "mailto:a@b"), ("b", "http://h.com", "http://h.com/b"), ("", "http://h.com/x", "http://h.com/x")]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "link string, base string, want string").select("want", urls.resolved(F.col("link"), F.col("base")).alias("got")).collect())


def test_lengthen(spark):
    raw = spark.createDataFrame([("http://bit.ly/a", 1.0), ("http://bit.ly/b", 2.0), ("http://bit.ly/c", 3.0), ("http://other.com/a", 4.0), ("http://bit.ly/d", 5.0), (None, 6.0)], "url string, score double")
    known = spark.createDataFrame([("http://bit.ly/a", 301, "http://long.com/"), ("http://bit.ly/b", 404, None), ("http://bit.ly/c", 301, "/relative"), ("http://other.com/a", 301, "http://no.com/"), ("http://bit.ly/d", 200, "http://found.com/")], "url string, status int, location string")
    got = {r.score: r.url for r in clean.lengthen(raw, known).collect()}
    assert got == {1.0: "http://long.com/", 2.0: "http://bit.ly/b", 3.0: "http://bit.ly/c", 4.0: "http://other.com/a", 5.0: "http://found.com/", 6.0: None}


def test_clean_gives_states(spark):
    got = clean.clean(spark.createDataFrame([("Site.org/a/../b", 2.0), ("javascript:x", 1.0), ("ftp://a.b", 1.0)], "url string, score double"), 77).collect()
    assert [(r.url, r.pld, r.status, r.status_time, r.score) for r in got] == [("http://site.org/b", "site.org", "UNFETCHED", 77, 2.0)]


def slow_joaat64(data):
    mask, wrap = (1 << 64) - 1, lambda x: x - (1 << 64) if x >> 63 else x
    r = 0
    for b in data:
        r = (r + b) & mask
        r = (r + (r << 20)) & mask
        r ^= (wrap(r) >> 12) & mask
    r = (r + (r << 6)) & mask
    r ^= (wrap(r) >> 22) & mask
    return wrap((r + (r << 30)) & mask)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=20))
def test_joaat64_against_python(texts):
    assert hashing.joaat64(texts).tolist() == [slow_joaat64(t.encode("utf-8", "surrogatepass")) for t in texts]


def test_bloom_filter():
    import numpy as np

    f = hashing.BloomFilter(1000, 0.01)
    keys = hashing.joaat64([f"u{k}" for k in range(1000)])
    f.add(keys)
    assert f.contains(keys).all() and f.contains(hashing.joaat64([f"v{k}" for k in range(2000)])).mean() < 0.05
    assert f.union(hashing.BloomFilter(1000, 0.01)).contains(np.array(keys[:1]))[0]


def test_suffix_list_can_be_read():
    s = suffixes.Suffixes.read(["// comment", "com", "co.uk", "*.ck", "!www.ck", "a.b.c"])
    assert s == suffixes.Suffixes(frozenset({"com", "ck"}), frozenset({"co.uk"}), frozenset({"ck"}), frozenset({"a.b.c"}), frozenset({"www.ck"}))
