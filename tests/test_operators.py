"""Crawl operators: states, queue, politeness, robots, pages, archive, records."""

import gzip
import io
import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trawlnet.functions import html, http, robots as robots_txt, warc
from trawlnet.functions.language import detect
from trawlnet.functions.text import language_code, one_line, split_on
from trawlnet.operators import archive, crawldb, fetch, parse, robots, sitemap
from trawlnet.schema import CRAWL_STATE, PRIORITY, STATUSES
from trawlnet.sinks import outputs
from trawlnet.sources import archive_index, seeds
from trawlnet.sources.warc import WarcSource


def states(spark, *rows):
    return spark.createDataFrame([(u, "d", s, None, t, float(x), n, q) for q, (u, s, t, x, n) in enumerate(rows)], CRAWL_STATE + ", seq int")


def merged(spark, *rows):
    return {r.url: (r.status, r.status_time, r.score, r.next_fetch_time) for r in crawldb.merge(states(spark, *rows)).collect()}


def test_statuses():
    assert len(STATUSES) == 26 == len(set(STATUSES)) and PRIORITY["UNFETCHED"] == 0 and PRIORITY["FETCHED"] == 25 and PRIORITY["HTTP_GONE"] == 50


def test_merge(spark):
    U = "UNFETCHED"
    assert merged(spark, ("a", U, 3, 1, 9), ("a", U, 5, 0.5, 7), ("b", U, 1, 1, 0), ("b", "FETCHED", 4, 0, 2), ("b", U, 9, 5, 0)) == {"a": (U, 5, 1.5, 7), "b": ("FETCHED", 4, 0.0, 2)}
    assert merged(spark, ("a", "FETCHING", 4, 1, 0), ("a", "FETCHED", 5, 0, 0)) == {"a": ("FETCHED", 5, 0.0, 0)}
    assert merged(spark, ("a", "FETCHING", 5, 1, 1), ("a", "FETCHED", 5, 0, 0)) == {"a": ("FETCHING", 5, 1.0, 1)}


def test_impossible_states_are_errors(spark):
    with pytest.raises(PySparkException):
        crawldb.checked(states(spark, ("a", "FETCHED", 0, 1, 0))).collect()
    with pytest.raises(PySparkException):
        crawldb.checked_new(states(spark, ("a", "QUEUED", 1, 1, 0))).collect()
    assert crawldb.checked(states(spark, ("a", "UNFETCHED", 0, 1, 0))).count() == 1


def test_queue(spark):
    rows = states(spark, ("a", "UNFETCHED", 1, 1.0, 0), ("b", "UNFETCHED", 1, 1.5, 0), ("c", "UNFETCHED", 1, 0.5, 0), ("d", "UNFETCHED", 1, 2.0, 0), ("e", "FETCHED", 1, 9, 0), ("f", "UNFETCHED", 1, -1, 0))
    assert [r.url for r in crawldb.fetch_queue(rows, 2).orderBy("rank").collect()] == ["d", "b"]
    assert {r.url for r in crawldb.fetch_queue(rows, 10, 0.75).collect()} == {"a", "b", "d"}
    assert {r.url for r in crawldb.fetch_queue(rows, 1, shard=F.col("url") > "b").collect()} == {"b", "d"}
    marked = crawldb.queued(rows, crawldb.fetch_queue(rows, 2), 5)
    assert {(r.url, r.status, r.previous_status) for r in marked.filter("status = 'QUEUED'").collect()} == {("d", "QUEUED", "UNFETCHED"), ("b", "QUEUED", "UNFETCHED")}
    assert {r.status for r in crawldb.evicted(marked.filter("status = 'QUEUED'")).collect()} == {"UNFETCHED"}
    assert {r.url for r in crawldb.without_archived(rows, rows.filter("url = 'a'")).collect()} == set("bcdef")


def test_intervals_and_quota(spark):
    scores = spark.createDataFrame([("p", 1.0), ("q", 10.0), ("r", 1e-9), ("s", 1e9)], "pld string, score double")
    average = scores.filter("pld in ('p', 'q')")
    assert {r.pld: r.interval_ms for r in crawldb.check_intervals(average).collect()} == {"p": 1000, "q": 110}
    assert {r.interval_ms for r in crawldb.check_intervals(scores).filter("pld in ('r', 's')").collect()} == {1000, 50}
    rows = spark.createDataFrame([(f"u{k}", "q", float(k)) for k in range(20)] + [(f"v{k}", "z", float(k)) for k in range(5)], "url string, pld string, score double")
    got = [r.url for r in crawldb.within_quota(rows, crawldb.check_intervals(average), 1000).collect()]
    assert sorted(got) == sorted(["v4"] + [f"u{k}" for k in range(10, 20)])
    latest = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 0.0)], "pld string, seq int, score double")
    assert crawldb.latest_scores(latest).first().score == 0.01


def test_moving_average(spark):
    rows = spark.createDataFrame([("p", k, float(k)) for k in range(15)], "pld string, seq int, score double")
    got = {r.seq: r.average for r in crawldb.moving_average(rows).collect()}
    assert got[0] == 0 and got[3] == 1.5 and got[14] == 9.5


def test_timed_counter():
    c = fetch.TimedCounter(3)
    for t, want in ((1000, [0, 0, 1]), (1400, [0, 0, 2]), (2000, [0, 2, 1]), (2999, [0, 2, 2])):
        c.increment(t)
        assert c.counts.tolist() == want
    c.increment(4100)
    assert c.counts.tolist() == [2, 0, 1] and c.total == 3
    c.increment(9000)
    assert c.counts.tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        c.increment(8000)


def test_politeness(spark):
    rows = [("o", 0, 1, 10), ("o", 5, 2, 10), ("o", 10, 3, 10), ("o", 10, 4, 0), ("p", 3, 1, 0), ("p", 3, 2, 0), ("q", 1, 1, None)]
    got = fetch.politeness_gate(spark.createDataFrame(rows, "origin string, now bigint, seq int, crawl_delay_ms bigint")).orderBy("origin", "seq").collect()
    assert [(r.passed, r.next_fetch_time) for r in got] == [(True, None), (False, 10), (True, None), (False, 20), (True, None), (True, None), (True, None)]
    held = spark.createDataFrame([("o", 5, 1, 10, 9), ("o", 9, 2, 10, 9)], "origin string, now bigint, seq int, crawl_delay_ms bigint, start_time bigint")
    assert [r.passed for r in fetch.politeness_gate(held).orderBy("seq").collect()] == [False, True]


def test_fetch_results(spark):
    table = fetch.TableFetcher(spark.createDataFrame([("a", 200, bytearray(b"x"), "text/html"), ("b", 200, bytearray(b"y"), "image/png"), ("c", 200, bytearray(b"z" * 50), "text/html"), ("d", 301, None, None)], "url string, code int, content binary, content_type string"), fetch.FetchSettings(mime_types=fetch.HTML_ONLY, max_size=10))
    requests = spark.createDataFrame([(u, 1.0) for u in "abcde"], "url string, score double")
    got = {r.url: r.status for r in fetch.results(requests, table(requests), 5).collect()}
    assert got == {"a": "FETCHED", "b": "ABORTED_FETCH_SETTINGS", "c": "ABORTED_FETCH_SETTINGS", "d": "HTTP_MOVED_PERMANENTLY", "e": "HTTP_NOT_FOUND"}
    assert {r.status for r in fetch.results(requests, fetch.nothing(requests), 5).collect()} == {"HTTP_NOT_FOUND"}
    with pytest.raises(ValueError):
        fetch.HttpFetcher(fetch.FetchSettings())


def test_http_fetch_names_failures():
    got = fetch.fetch_one("http://127.0.0.1:9/none", fetch.FetchSettings(agent="t", timeout_s=2))
    assert got[2] == "io" and fetch.fetch_one("nonsense", fetch.FetchSettings(agent="t"))[2] == "url"


def test_http_fetch_from_a_local_server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code = {"/moved": 301, "/gone": 410}.get(self.path, 200)
            self.send_response(code)
            if code == 301:
                self.send_header("Location", "/page")
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"hello")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        s = fetch.FetchSettings(agent="t", timeout_s=5)
        assert fetch.fetch_one(f"{base}/page", s)[1:4] == (200, None, f"{base}/page")
        assert fetch.fetch_one(f"{base}/moved", s)[3] == f"{base}/page"
        assert fetch.fetch_one(f"{base}/moved", fetch.FetchSettings(agent="t", follow="none"))[1] == 301
        assert fetch.fetch_one(f"{base}/gone", s)[1] == 410
        assert fetch.fetch_one(f"{base}/page", fetch.FetchSettings(agent="t", max_size=3))[2] == "content_size"
        assert fetch.fetch_one(f"{base}/page", fetch.FetchSettings(agent="t", mime_types=("image/png",)))[2] == "mime_type"
    finally:
        server.shutdown()


def test_http_statuses_agree(spark):
    got = spark.range(100, 600).select("id", http.status_of_code(F.col("id")).alias("s")).collect()
    assert all(r.s == http.http_status(r.id) for r in got)


ROBOTS = """User-agent: other
Disallow: /

User-agent: *
User-agent: mybot # names
Disallow: /private
Allow: /private/open
Disallow: /*.gif$
Disallow:
Crawl-delay: 1.5
sitemap : http://a.com/map.xml
"""


@pytest.mark.parametrize(("path", "ok"), [("/", True), ("/private", False), ("/private/x", False), ("/private/open/x", True), ("/a.gif", False), ("/a.gif?x", True)])
def test_robots_rules(spark, path, ok):
    for agent in ("*", "MyBot/2.0"):
        rules = robots_txt.parse(ROBOTS, agent)
        assert rules.allows(path) == ok and rules.crawl_delay_ms == 1500 and rules.sitemaps == ["http://a.com/map.xml"]
    assert not robots_txt.parse(ROBOTS, "other").allows("/x")


def test_robots_files_of_all_kinds():
    assert robots_txt.parse("").allows("/x") and robots_txt.parse(None).allow == "all" and robots_txt.parse("﻿User-agent: *\nDisallow: /").allows("/x") is False
    assert robots_txt.failed(404).allows("/x") and robots_txt.failed(500).defer and not robots_txt.failed(302).allows("/x")


def test_robots_gate(spark):
    responses = spark.createDataFrame([("http://a.com", 200, ROBOTS), ("http://b.com", 404, None), ("http://c.com", None, None)], "origin string, code int, body string")
    rules = robots.rules_of(responses, 1000)
    assert {r.origin: r.expires_at for r in rules.collect()} == {"http://a.com": 1000 + 12 * 3600_000, "http://b.com": 1000 + 24 * 3600_000, "http://c.com": 1000 + 3600_000}
    asked = ["http://a.com", "http://a.com/private/x", "http://a.com/private/open", "http://a.com/p.gif", "http://b.com/x", "http://c.com/", "http://d.com/"]
    got = {r.url: (r.outcome, r.status, r.crawl_delay_ms, r.next_fetch_time) for r in robots.gate(spark.createDataFrame([(u, 1.0) for u in asked], "url string, score double"), rules, 7).collect()}
    blocked = ("blocked", "SKIPPED_BLOCKED", None, 100_000_007)
    assert got == {asked[0]: ("passed", None, 1500, None), asked[1]: blocked, asked[2]: ("passed", None, 1500, None), asked[3]: blocked, asked[4]: ("passed", None, 10_000, None), asked[5]: ("blocked", "SKIPPED_DEFERRED", None, 100_000_007), asked[6]: ("passed", None, 10_000, None)}
    assert robots.gate(spark.createDataFrame([(asked[0], 1.0)], "url string, score double"), rules, 7, forced_delay_ms=3).first().crawl_delay_ms == 3
    assert [r.url for r in robots.missing(spark.createDataFrame([(u,) for u in asked], "url string"), rules, 2000).collect()] == ["http://d.com/robots.txt"]
    assert [r.url for r in robots.sitemap_requests(rules).collect()] == ["http://a.com/map.xml"]


def test_sitemaps(spark):
    maps = [("FETCHED", b"http://a.com/1\r\n\n http://a.com/2 "), ("FETCHED", b'\xef\xbb\xbf<?xml version="1.0"?><urlset><url><loc>\nhttp://a.com/3?x&amp;y </loc></url><url><loc><![CDATA[http://a.com/4]]></loc></url></urlset>'), ("FETCHED", b"<sitemapindex><sitemap><loc>http://a.com/5</loc></sitemap></sitemapindex>"), ("HTTP_GONE", b"http://a.com/6"), ("FETCHED", None)]
    got = sitemap.expand(spark.createDataFrame([(s, bytearray(c) if c else None) for s, c in maps], "status string, content binary")).collect()
    assert sorted(r.url for r in got) == ["http://a.com/1", "http://a.com/2", "http://a.com/3?x&y", "http://a.com/4"]


PAGE = """<html lang="fr-CH"><head><title>A &amp; B</title><meta name="Author" content="me"><base href="/dir/"></head><body>One <a href="x" rel="nofollow">first <b>link</b></a>
<script>var t = '<a href="no">';</script><a href="x">again</a><a href='http://o.com/#f'>o</a><img src="i.png"><a name="n">none</a><a href=" /abs ">abs"""


def test_pages():
    page = html.read(PAGE, "http://h.com/a/b")
    assert page.title == "A & B" and page.language == "fr-CH" and page.meta == {"author": "me"} and page.text.startswith("A & B") and "One first link" in page.text and "var t" not in page.text
    assert [(k.url, k.anchor_text, k.rel) for k in page.links] == [("http://h.com/dir/x", "first link", "nofollow"), ("http://o.com/#f", "o", ""), ("http://h.com/abs", "abs", "")]
    assert "http://h.com/dir/i.png" in [k.url for k in html.read(PAGE, "http://h.com/", html.ALL_LINK_TAGS, html.ALL_LINK_ATTRIBUTES).links]
    assert html.read('<meta name="robots" content="index, NoFollow"><a href="/x">').links == []
    assert len(html.read("".join(f'<a href="/{k}">' for k in range(99)), "http://h.com").links) == 51
    assert html.read(None).text == "" and html.read("<" * 1000).links == []


def results(spark, *pages):
    rows = [(u, 1.0, s, 5, f, {"Content-Language": ["de-DE"]} if k == 0 else {}, bytearray(c), "text/html; charset=latin-1", 1, 0) for k, (u, s, f, c) in enumerate(pages)]
    return spark.createDataFrame(rows, "url string, score double, status string, status_time bigint, fetched_url string, headers map<string,array<string>>, content binary, content_type string, response_rate int, next_fetch_time bigint")


def test_parse_operator(spark):
    fetched = results(spark, ("http://a.com/", "FETCHED", "http://b.com/p", '<title>3.5</title><a href="/1">é</a><a href="/2">y</a>'.encode("latin-1")), ("http://a.com/x", "HTTP_GONE", "", b""), ("http://c.com/", "FETCHED", "http://c.com/", b""))
    got = {r.url: r for r in parse.parse(fetched, lambda: F.when(F.col("title") != "", F.col("title").cast("double")).otherwise(0.0)).collect()}
    assert set(got) == {"http://a.com/", "http://c.com/"}
    a = got["http://a.com/"]
    assert a.score == 3.5 and a.language == "de" and [(k.url, k.score, k.anchor_text) for k in a.outlinks] == [("http://b.com/1", 1.75, "é"), ("http://b.com/2", 1.75, "y")]
    parsed = parse.parse(fetched, lambda: F.lit(0.0))
    assert parse.texts(parsed).count() == 0 and parse.outlinks(parsed).count() == 2
    assert {(r.pld, r.score) for r in parse.domain_scores(parsed, F.lit(1)).collect()} == {("b.com", 0.0), ("c.com", 0.0)}
    assert [r.url for r in parse.outlinks(parse.parse(fetched), 1).collect()] == ["http://b.com/1"]
    links = spark.createDataFrame([("p", k, f"u{k}", s) for k, s in enumerate((1.0, 3.0, 2.0))], "page string, position int, url string, score double")
    assert {r.url for r in parse.top_links(links, 2).collect()} == {"u1", "u2"}
    with pytest.raises(ValueError):
        parse.ParserSettings(max_duration_ms=99)


def test_quick_links_agree_with_the_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {(r.url, k.url) for r in pages.collect() for k in html.read(r.html, r.url).links}
    assert {(r.page, r.url) for r in parse.quick_links(pages).collect()} == want


def test_top_links_of_pages_with_the_same_url_have_an_order(spark):
    links = [("p", k, u, s) for k, u, s in ((0, "a", 1), (0, "b", 1), (1, "d", 2), (1, "c", 2), (2, "e", 2))]
    for rows in (links, links[::-1]):
        got = parse.top_links(spark.createDataFrame(rows, "page string, position int, url string, score int").coalesce(1), 4).collect()
        assert sorted(r.url for r in got) == ["a", "c", "d", "e"]


def test_text_helpers(spark):
    row = spark.createDataFrame([("a\t\tb", "x\ty\r\nz", "en-US", "q")], "a string, b string, c string, d string").select(split_on(F.col("a"), "\t"), one_line(F.col("b")), language_code(F.col("c")), language_code(F.col("d"))).first()
    assert tuple(row) == (["a", "", "b"], "x y  z", "en", "q")
    kinds = spark.createDataFrame([('Text/HTML; charset="UTF-8"',), (None,), ("a/b",)], "t string").select(http.mime_type(F.col("t")), http.charset(F.col("t"))).collect()
    assert [tuple(r) for r in kinds] == [("text/html", "UTF-8"), ("", ""), ("a/b", "")]


def test_language():
    assert detect("the quick brown fox and the other animals were in the house that they had built for them") == "en"
    assert detect("der schnelle braune Fuchs und die anderen Tiere sind nicht in dem Haus, das sie für sich gebaut haben") == "de"
    assert detect("le renard brun et les autres animaux sont dans la maison que nous avons faite pour eux avec vous") == "fr"
    assert detect("el zorro marrón y los otros animales están en la casa que han hecho para ellos con una puerta") == "es"
    assert detect("") == "" == detect(None) == detect("123")


def test_seeds(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# comment\n\n  http://a.com/ \nb.com\n")
    assert [(r.url, r.score) for r in seeds.read(spark, str(tmp_path / "s.txt"), 2).collect()] == [("http://a.com/", 2.0), ("b.com", 2.0)]
    assert [(r.url, r.score) for r in seeds.of_urls(spark, [("x", 3.0)]).collect()] == [("x", 3.0)]


def test_index_lines(spark):
    lines = spark.createDataFrame([("com,a)/ 20200101\tcdx-1.gz\t10\t20\t3",), ("",)], "value string")
    assert tuple(archive_index.segments(lines).first()) == ("com,a)/", "20200101", "cdx-1.gz", 10, 20, 3)
    with pytest.raises(PySparkException):
        archive_index.segments(spark.createDataFrame([("not one",)], "value string")).collect()
    cdx = spark.createDataFrame([('com,a)/ 20200101 {"url": "http://a.com/", "status": "200", "mime": "text/html", "filename": "f", "offset": "5", "length": "6"}',), ("bad",)], "value string")
    assert [tuple(r) for r in archive_index.cdx(cdx).collect()] == [("com,a)/", 20200101, "http://a.com/", 200, "text/html", "f", 5, 6)]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_floor_lookup(spark, ranges):
    keys = [f"k{k:03d}" for k in range(0, 200, 7)]
    probes = [(f"k{k:03d}", k) for k in range(0, 220, 3)] + [("a", -1), ("zz", 999)]
    index = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, n int")
    got = {r.id: r.entry.key if r.entry else None for r in archive.floor_lookup(spark.createDataFrame(probes, "key string, id int"), index, ranges).collect()}
    assert got == {i: max((k for k in keys if k <= p), default=None) for p, i in probes}
    assert archive.floor_lookup(spark.createDataFrame(probes, "key string, id int"), index.limit(0), ranges).filter("entry is not null").count() == 0


def test_redirects(spark):
    hops = spark.createDataFrame([("http://a/1", 301, "/2"), ("http://a/2", 302, "http://b/3"), ("http://b/3", 200, None), ("http://a/l", 301, "/l"), ("http://a/s", 303, "/2")], "url string, code int, location string")
    asked = spark.createDataFrame([("http://a/1",), ("http://a/l",), ("http://a/x",), ("http://a/s",)], "url string")
    got = {r.url: (r.final_url, r.code, r.n_redirects, r.failure) for r in archive.follow(asked, hops, "all", 2).collect()}
    assert got == {"http://a/1": ("http://b/3", 200, 2, None), "http://a/l": ("http://a/l", 301, 2, "too_many_redirects"), "http://a/x": ("http://a/x", 404, 0, None), "http://a/s": ("http://b/3", 200, 2, None)}
    got = {r.url: (r.final_url, r.failure) for r in archive.follow(asked, hops, "temporary", 3).collect()}
    assert got["http://a/1"] == ("http://a/1", "permanent_redirect") and got["http://a/s"] == ("http://b/3", None)
    assert {r.failure for r in archive.follow(asked, hops, "none").collect()} == {"permanent_redirect", "see_other", None}


def test_archive_fetch(spark, tmp_path):
    def record(url, head, body, extra=()):
        content = f"HTTP/1.1 {head}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in extra) + b"\r\n" + body
        return gzip.compress(warc.Record([("WARC-Type", "response"), ("WARC-Target-URI", url)] + ([("WARC-Truncated", "length")] if b"cut" in body else []), content).encode())

    stored = [("http://a.com/", 200, record("http://a.com/", "200 OK", b"home", [("content-type", "text/html")])), ("http://a.com/old", 301, record("http://a.com/old", "301 Moved", b"", [("Location", "/")])), ("http://a.com/cut", 200, record("http://a.com/cut", "200 OK", b"cut", [("Content-Type", "image/png")]))]
    rows, data = [], b""
    for url, code, raw in stored:
        rows.append((url, code, len(data), len(raw)))
        data += raw
    os.makedirs(tmp_path / "arc")
    (tmp_path / "arc" / "f.warc.gz").write_bytes(data)
    from trawlnet.functions import urls

    cdx = spark.createDataFrame(rows, "url string, status int, offset bigint, length bigint").select(urls.archive_key(F.col("url")).alias("key"), F.lit(20200101).cast("bigint").alias("timestamp"), "url", "status", F.lit("text/html").alias("mime"), F.lit("f.warc.gz").alias("filename"), "offset", "length", F.col("offset").alias("position"))
    asked = spark.createDataFrame([("http://a.com/",), ("http://a.com/old",), ("http://a.com/cut",), ("http://a.com/none",)], "url string")
    got = {r.url: (r.code, r.failure, r.fetched_url, bytes(r.content) if r.content else None) for r in archive.archived(asked, cdx, f"file://{tmp_path}/arc", fetch.FetchSettings(max_redirects=3)).collect()}
    assert got["http://a.com/"] == (200, None, "http://a.com/", b"home") and got["http://a.com/old"] == (200, None, "http://a.com/", b"home")
    assert got["http://a.com/cut"][:2] == (200, "content_size") and got["http://a.com/none"][:2] == (404, None)


def test_best_capture(spark):
    rows = [("http://a.com/", 404, 9, 0), ("http://a.com/", 200, 5, 1), ("http://a.com/", 200, 7, 2), ("http://a.com/", 200, 7, 3), ("https://a.com/", 200, 99, 4), ("http://b.com/", 404, 1, 5), ("http://b.com/", 301, 2, 6)]
    from trawlnet.functions import urls

    cdx = spark.createDataFrame(rows, "url string, status int, timestamp bigint, position bigint").withColumn("key", urls.archive_key(F.col("url")))
    got = {r.url: r.capture.position if r.capture else None for r in archive.best_capture(spark.createDataFrame([("http://a.com/",), ("http://b.com/",), ("http://c.com/",)], "url string"), cdx).collect()}
    assert got == {"http://a.com/": 2, "http://b.com/": 6, "http://c.com/": None}


headers = st.lists(st.tuples(st.from_regex(r"[A-Za-z][A-Za-z0-9-]{0,12}", fullmatch=True).filter(lambda k: k.lower() != "content-length"), st.from_regex(r"([!-~]([ -~]{0,20}[!-~])?)?", fullmatch=True)), max_size=6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(headers, st.binary(max_size=200)), max_size=5))
def test_records_round_trip(records):
    data = b"".join(warc.Record(h, c).encode() for h, c in records)
    got = list(warc.read(io.BytesIO(data)))
    assert [(r.headers[:-1], r.content) for r in got] == records and all(r.get("content-length") == str(len(r.content)) for r in got)


def test_bad_records():
    for data in (b"HTTP/1.0\r\n\r\n", b"WARC/1.0\r\nX: 1\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.0\r\nno colon\r\n\r\n", b"WARC/1.0\r\nA: " + b"x" * 20_000 + b"\r\n\r\n"):
        with pytest.raises(warc.FormatError):
            list(warc.read(io.BytesIO(data)))
    assert next(warc.read(io.BytesIO(b"WARC/1.0\r\nA: 1\r\n  2\r\nContent-Length: 0\r\n\r\n"))).get("a") == "1 2"


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_source(spark, tmp_path, compressed):
    folder = str(tmp_path / "w")
    fetched = results(spark, *[(f"http://a.com/{k}", "FETCHED" if k % 2 == 0 else "HTTP_GONE", f"http://a.com/{k}", os.urandom(3000)) for k in range(10)]).coalesce(1)
    outputs.write_warc(fetched, folder, compressed, maxBytes="5000")
    files = [f for f in os.listdir(folder) if not f.startswith(".")]
    assert len(files) > 1 and all(f.endswith(".warc.gz" if compressed else ".warc") for f in files)
    spark.dataSource.register(WarcSource)
    rows = spark.read.format("warc").load(folder).collect()
    kinds = [dict((h.name, h.value) for h in r.headers) for r in rows]
    assert sorted(k["WARC-Target-URI"] for k in kinds if k["WARC-Type"] == "resource") == [f"http://a.com/{k}" for k in range(0, 10, 2)]
    assert {r.fetched_url: bytes(r.content) for r in fetched.collect() if r.status == "FETCHED"} == {k["WARC-Target-URI"]: bytes(r.content) for k, r in zip(kinds, rows) if k["WARC-Type"] == "resource"}


def test_warc_reading_holds_a_few_records_at_once(tmp_path):
    from trawlnet.sources.warc import PIECE_BYTES, PIECE_ROWS

    bodies = [os.urandom(1_000_000) for _ in range(11)] + [b"x"] * (PIECE_ROWS + 1) + [b""]
    (tmp_path / "a.warc").write_bytes(b"".join(warc.Record([("N", str(k))], c).encode() for k, c in enumerate(bodies)))
    reader = WarcSource({"path": str(tmp_path)}).reader(None)
    pieces = [p for part in reader.partitions() for p in reader.read(part)]
    assert max(p.num_rows for p in pieces) <= PIECE_ROWS and max(p.nbytes for p in pieces) < PIECE_BYTES + 1_100_000
    assert [c for p in pieces for c in p.column("content").to_pylist()] == bodies
    assert [h[0]["value"] for p in pieces for h in p.column("headers").to_pylist()] == [str(k) for k in range(len(bodies))]


def test_warc_records_of_missing_contents_and_types(spark, tmp_path):
    rows = [("FETCHED", f"http://a.com/{k}", k, None if k % 2 else "text/html", None if k % 3 == 0 else bytearray(b"x" * k)) for k in range(1200)]
    fetched = spark.createDataFrame(rows, "status string, fetched_url string, status_time bigint, content_type string, content binary").coalesce(1)
    outputs.write_warc(fetched, str(tmp_path / "w"))
    spark.dataSource.register(WarcSource)
    got = [({h.name: h.value for h in r.headers}, bytes(r.content)) for r in spark.read.format("warc").load(str(tmp_path / "w")).collect()]
    assert [h["WARC-Type"] for h, _ in got] == ["warcinfo"] + ["resource"] * 1200
    assert [(h["WARC-Target-URI"], h["Content-Type"], c) for h, c in got[1:]] == [(u, kind or "application/octet-stream", bytes(c or b"")) for _, u, _, kind, c in rows]


def test_json_of_rules_is_plain(spark):
    rules = robots.rules_of(spark.createDataFrame([("o", 200, ROBOTS)], "origin string, code int, body string"), 0)
    assert json.loads(rules.select(F.to_json("rules")).first()[0])[0] == {"allowed": False, "prefix": "/private", "size": 8}


def test_language_of_prose_after_a_long_numeric_heading():
    from trawlnet.functions.language import detect

    prose = "the people who live in this house have been there for many years and they do not want to move"
    assert detect("0123 456 | 789 -- " * 200 + prose) == detect(prose) == "en"
    assert detect("12 345 " * 200 + "the people") == ""


def test_warc_dates_are_utc_in_any_time_zone(spark):
    from trawlnet.sinks import outputs

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("FETCHED", "http://a.com/", 1_700_000_000_000, "text/html", bytearray(b"x"))]
        results = spark.createDataFrame(rows, "status string, fetched_url string, status_time bigint, content_type string, content binary")
        dates = {h["value"] for r in outputs.warc_records(results).collect() for h in r.headers if h["name"] == "WARC-Date"}
        assert dates == {"2023-11-14T22:13:20Z"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_page_that_takes_too_long_fails():
    import time

    from trawlnet.operators.parse import limited

    began = time.perf_counter()
    with pytest.raises(TimeoutError), limited(150):
        while True:
            pass
    assert time.perf_counter() - began < 5
    with limited(100_000):
        pass
    time.sleep(0.2)


def test_connections_of_a_host_are_bounded():
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    from trawlnet.operators.fetch import by_host

    lock, flying, most = threading.Lock(), {}, {}

    def get(url):
        name = url.split("/")[2]
        with lock:
            flying[name] = flying.get(name, 0) + 1
            most[name] = max(most.get(name, 0), flying[name])
        time.sleep(0.01)
        with lock:
            flying[name] -= 1
        return (url,)

    wanted = [f"http://h{k % 3}.com/{k}" for k in range(45)]
    with ThreadPoolExecutor(12) as pool:
        assert by_host(wanted, get, 2, pool) == [(u,) for u in wanted]
    assert set(most.values()) == {2}


def test_suffixes_of_any_length(spark):
    from trawlnet.functions import suffixes, urls

    known = suffixes.Suffixes.read(["// no", "com", "uk", "co.uk", "city.kawasaki.jp", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "k12.ca.us", "us", "ca.us"])
    rows = {"a.b.com": "b.com", "x.co.uk": "x.co.uk", "a.b.k12.ca.us": "b.k12.ca.us", "a.b.ca.us": "b.ca.us", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "a.www.ck": "www.ck", "a.b.c.ck": "b.c.ck"}
    df = spark.createDataFrame([(k,) for k in rows], "h string")
    assert {r.h: r.p for r in df.select("h", urls.pld_of_host(F.col("h"), known).alias("p")).collect()} == rows


def test_shortener_hosts():
    from trawlnet.functions import shorteners

    assert len(shorteners.BUILT_IN) >= 236 and {"bit.ly", "t.co", "goo.gl", "p.ost.im", "on.wsj.com"} <= set(shorteners.BUILT_IN)


def test_follow_names_a_redirect_without_a_target(spark):
    from trawlnet.operators import archive

    hops = spark.createDataFrame([("http://a.com/", 301, None), ("http://b.com/", 302, "http://c.com/"), ("http://c.com/", 200, None)], "url string, code int, location string")
    got = {r.url: (r.final_url, r.code, r.n_redirects, r.failure) for r in archive.follow(spark.createDataFrame([("http://a.com/",), ("http://b.com/",)], "url string"), hops).collect()}
    assert got == {"http://a.com/": ("http://a.com/", 301, 0, "permanent_redirect"), "http://b.com/": ("http://c.com/", 200, 1, None)}
