"""Whole crawls over small webs, streams, the command line, and the registered queries against their SQL."""

import os
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trawlnet.functions import urls
from trawlnet.operators import crawldb, fetch, parse
from trawlnet.plans import cli, crawl, terminate
from trawlnet.plans import queries as crawl_queries
from trawlnet.sources import seeds
from trawlnet.streaming import processors

N = urls.normalize


def web(spark, graph, scores=None):
    """A fetcher over {page: links}; a page's title names its score."""
    rows = []
    for page, links in graph.items():
        items = "".join(f'<li><a href="{N(k)}">link</a></li>' for k in links)
        body = f"<html><head><title>Made-up page, score={(scores or {}).get(page, 1.0)}</title></head><body><ul>{items}</ul></body></html>"
        rows.append((N(page), 200, bytearray(body.encode()), "text/html"))
    return fetch.TableFetcher(spark.createDataFrame(rows, "url string, code int, content binary, content_type string"))


def titled():
    return F.regexp_extract("title", "score=([0-9.]+)", 1).cast("double")


def files(spark, contents):
    return fetch.TableFetcher(spark.createDataFrame([(u, 200, bytearray(t.encode()), "text/plain") for u, t in contents.items()], "url string, code int, content binary, content_type string"))


def fetched(outcome):
    return sorted(r.url for r in outcome.events.filter("stage = 'fetch'").collect())


def test_focused_crawl(spark, tmp_path):
    graph = {"d1.com": ["d1.com/a", "d1.com/b"], "d1.com/a": ["d1.com/c", "d2.com/e"], "d1.com/b": ["d1.com/d"], "d1.com/c": [], "d1.com/d": ["d2.com/e"], "d2.com/e": []}
    job = crawl.Crawl(web(spark, graph, {"d1.com": 2.0}), scorer=titled, min_score=0.75, default_delay_ms=0, text_path=str(tmp_path / "text"), max_rounds=8)
    out = crawl.run(spark, job, seeds.of_urls(spark, ["http://d1.com"]), str(tmp_path / "crawl"), 1_000)
    assert fetched(out) == sorted(N(u) for u in graph if u != "d1.com/c")
    left = {r.url: (r.status, r.score) for r in out.states.collect()}
    assert left[N("d1.com/c")] == ("UNFETCHED", 0.5) and left[N("d2.com/e")][0] == "FETCHED"
    assert crawl.metrics(out)["status.FETCHED"] == 5 and crawl.metrics(out)["pages_parsed"] == 5
    lines = [r.value for r in spark.read.text(str(tmp_path / "text")).collect()]
    assert len(lines) == 5 and all("\t" in x for x in lines)
    assert {r.pld for r in out.scores.collect()} == {"d1.com", "d2.com"}


def test_broad_crawl(spark, tmp_path):
    graph = {"d1.com": ["d1.com/p1", "d1.com/p2", "d1.com/blocked"], "d1.com/p1": [], "d1.com/p2": ["d2.com", "d1.com", "d1.com/p1"], "d2.com": ["d2.com/p1", "d3.com"], "d3.com": ["d3.com/p1", "bit.ly/d4"], "d4.com": []}
    robots = files(spark, {"http://d1.com/robots.txt": "User-agent: *\r\nDisallow: /blocked\r\nCrawl-delay: 0\r\n", "http://d3.com/robots.txt": "User-agent: *\nCrawl-delay: 30\n", "http://d4.com/robots.txt": "User-agent: *\nsitemap : http://d4.com/map.txt"})
    maps = files(spark, {"http://d4.com/map.txt": "http://d4.com/p1\nhttp://d4.com/p2\n"})
    redirects = spark.createDataFrame([("http://bit.ly/d4", 301, "http://d4.com/")], "url string, status int, location string")
    job = crawl.Crawl(web(spark, graph), robots_fetcher=robots, sitemap_fetcher=maps, redirects=redirects, default_delay_ms=0, warc_path=str(tmp_path / "warc"), max_rounds=12)
    out = crawl.run(spark, job, seeds.of_urls(spark, ["http://d1.com"]), str(tmp_path / "crawl"), 1_000)
    got = {r.url: r.status for r in out.states.collect()}
    assert got == {
        N("d1.com"): "FETCHED", N("d1.com/p1"): "FETCHED", N("d1.com/p2"): "FETCHED", N("d1.com/blocked"): "SKIPPED_BLOCKED", N("d2.com"): "FETCHED", N("d2.com/p1"): "HTTP_NOT_FOUND", N("d3.com"): "FETCHED",
        N("d3.com/p1"): "SKIPPED_CRAWLDELAY", N("d4.com"): "FETCHED", N("d4.com/p1"): "HTTP_NOT_FOUND", N("d4.com/p2"): "HTTP_NOT_FOUND",
    }
    seen = {(r.stage, r.url) for r in out.events.collect()}
    assert ("fetch", N("d1.com/blocked")) not in seen and ("parse", N("d2.com/p1")) not in seen and ("sitemap", "http://d4.com/map.txt") in seen
    assert all(fetched(out).count(u) == 1 for u in fetched(out))
    assert sum(f.endswith(".warc.gz") for f in os.listdir(tmp_path / "warc")) >= 1


def test_crawls_end(spark, tmp_path):
    graph = {f"d.com/{k}": [f"d.com/{k + 1}"] for k in range(9)}
    job = crawl.Crawl(web(spark, graph), default_delay_ms=0)
    start = seeds.of_urls(spark, ["http://d.com/0"])
    assert crawl.run(spark, job.with_(terminators=(terminate.after_rounds(2),)), start, str(tmp_path / "a"), 1).rounds == 2
    assert crawl.run(spark, job.with_(terminators=(terminate.after_seconds(0),)), start, str(tmp_path / "b"), 1).rounds == 0
    assert crawl.run(spark, job.with_(terminators=(terminate.after_pages(1),)), start, str(tmp_path / "c"), 1).rounds == 1
    assert crawl.run(spark, job, seeds.of_urls(spark, ["nonsense:x"]), str(tmp_path / "d"), 1).rounds == 0


def test_shards_and_pace_find_the_same(spark, tmp_path):
    graph = {"a.com": ["b.com", "c.com", "a.com/1"], "b.com": [], "c.com": [], "a.com/1": []}
    start = seeds.of_urls(spark, ["a.com"])
    for k, changes in enumerate(({"shards": 3}, {"paced": True, "queue_size": 2})):
        out = crawl.run(spark, crawl.Crawl(web(spark, graph), default_delay_ms=0, max_rounds=15, **changes), start, str(tmp_path / str(k)), 1)
        assert {r.url for r in out.states.filter("status = 'FETCHED'").collect()} == {N(u) for u in graph}


def test_crawl_settings():
    with pytest.raises(ValueError):
        crawl.Crawl(fetch.nothing, agent=crawl.PLACEHOLDER_AGENT)
    with pytest.raises(ValueError):
        crawl.Crawl(fetch.nothing, queue_size=0)
    text = crawl.dot(crawl.Crawl(fetch.nothing))
    assert '"parse" -> "clean" [style=dashed]' in text and "warc" not in text


def test_command_line(spark):
    assert cli.agent("bot,a@b.c,http://b.c").startswith("Mozilla/5.0 (compatible; bot/1.0")
    for bad in ("bot", "bot,ab,http://x", "bot,a@b,x"):
        with pytest.raises(ValueError):
            cli.agent(bad)
    parse_args = cli.parser().parse_args
    for args in (["-seedurls", "x"], ["-seedurls", "x", "-agent", "b,a@b,http://c", "-archive", "y", "-archiveindex", "z"], ["-seedurls", "x", "-archive", "y"]):
        with pytest.raises(ValueError):
            cli.checked(parse_args(args))
    job = cli.plan(spark, cli.checked(parse_args(["-seedurls", "x", "-agent", "b,a@b,http://c", "-htmlonly", "-maxduration", "5", "-forcecrawldelay", "7", "-minscore", "0.5"])))
    assert job.page_fetcher.settings.mime_types == fetch.HTML_ONLY and job.forced_delay_ms == 7 and job.agent == "b" and len(job.terminators) == 1 and job.min_score == 0.5


def streamed(spark, tmp_path, rows, schema, key, processor, parts=2):
    """Rows of a processor over a stream of `parts` files, restarted between them."""
    source, sink, checkpoint = (str(tmp_path / k) for k in ("in", "out", "ck"))
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(source)
        stream = processors.processed(spark.readStream.schema(schema).parquet(source), key, processor)
        run = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(120)
        time.sleep(0.1)
    return spark.read.parquet(sink)


def test_streamed_moving_average(spark, tmp_path):
    rows = [(f"d{k % 3}", k, float(k * k % 17)) for k in range(60)]
    schema = "pld string, seq bigint, score double"
    got = {(r.pld, r.seq): r.average for r in streamed(spark, tmp_path, rows, schema, "pld", processors.MovingAverage()).collect()}
    want = {(r.pld, r.seq): r.average for r in crawldb.moving_average(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_streamed_politeness(spark, tmp_path):
    rows = [(f"u{k}", f"o{k % 4}", k * 3, k, 10) for k in range(60)]
    schema = "url string, origin string, now bigint, seq bigint, crawl_delay_ms bigint"
    got = {r.url: (r.passed, r.next_fetch_time) for r in streamed(spark, tmp_path, rows, schema, "origin", processors.Politeness()).collect()}
    assert got == {r.url: (r.passed, r.next_fetch_time) for r in fetch.politeness_gate(spark.createDataFrame(rows, schema)).collect()}


def test_streamed_states(spark, tmp_path):
    kinds = ["UNFETCHED", "UNFETCHED", "FETCHING", "FETCHED"]
    rows = [(f"u{k % 11}", f"d{k % 11 % 3}", kinds[k * 7 % 4], None, k + 1, float(k), k, k) for k in range(80)]
    schema = "url string, pld string, status string, previous_status string, status_time bigint, score double, next_fetch_time bigint, seq bigint"
    out = streamed(spark, tmp_path, rows, schema, "pld", processors.CrawlDb()).collect()
    last = {}
    for r in out:  # the state of the greatest time holds
        if r.url not in last or (r.status != "UNFETCHED", r.status_time) >= (last[r.url].status != "UNFETCHED", last[r.url].status_time):
            last[r.url] = r
    want = {r.url: (r.status, r.status_time, r.score, r.next_fetch_time) for r in crawldb.merge(spark.createDataFrame(rows, schema)).collect()}
    assert {u: (r.status, r.status_time, r.score, r.next_fetch_time) for u, r in last.items()} == want


def test_streamed_queue_and_rules(spark, tmp_path):
    rows = [(0, "candidate", f"u{k}", float(k), k) for k in range(10)] + [(0, "done", "u9", 0.0, 20), (0, "candidate", "low", -1.0, 21)]
    got = streamed(spark, tmp_path / "q", rows, "shard bigint, kind string, url string, score double, seq bigint", "shard", processors.FetchQueue(size=5, most_in_flight=2), parts=1).collect()
    assert sorted(r.url for r in got if r.kind == "evicted") == [f"u{k}" for k in range(5)] and [r.url for r in got if r.kind == "fetch"] == ["u9", "u8"]
    asked = [("o", f"u{k}", k * 40, k) for k in range(6)]
    got = streamed(spark, tmp_path / "r", asked, "origin string, url string, now bigint, seq bigint", "origin", processors.RobotsCache(100)).collect()
    assert sorted(r.now for r in got if r.fetch_rules) == [0, 120]


def test_seed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# no\nhttp://a.com\n")
    found = []
    run = processors.each_batch(seeds.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, k: found.extend(r.url for r in df.collect()))
    assert run.awaitTermination(60) and found == ["http://a.com"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    return con


def canon(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(crawl_queries.QUERIES))
def test_query_against_sql(spark, tables, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    assert got
    if sql := entry.oracle_sql().get(name):
        result = tables.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert canon(tuple(r) for r in got) == canon(tuple(r[k] for k in order) for r in result.fetchall())


def of_pages(spark, folder, name, pages):
    """Rows of a query over pages (url, html), and those of its SQL."""
    spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    return canon(tuple(r) for r in df.collect()), canon(con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall())


def test_longest_links_of_a_page_with_many(spark, tmp_path):
    links = [f"/{'x' * k}" for k in range(1, 121)]
    got, want = of_pages(spark, tmp_path, "outlink_topk", [("http://a.com/p", "".join(f'<a href="{k}">x</a>' for k in links)), ("http://a.com/none", "no links")])
    assert got == want == canon([("http://a.com/p", k, "http://a.com" + links[k]) for k in (117, 118, 119)])


def test_parsed_pages_with_the_same_url_and_references_in_titles(spark, tmp_path):
    page = '<html lang="{}"><head><title> {} </title></head><body>{}</body></html>'.format
    a, b, c = '<a href="/1">x</a><a href="/1">x</a>', '<a href="/2">x</a><a href="/3">x</a>', '<a href="/ü">x</a>'
    pages = [("http://a.com/p", page("en", "a &quot;b&quot; &amp;amp; c&amp", a)), ("http://a.com/p", page("de-AT", "d", b)), ("http://a.com/q", page("", "&lt;e&gt;", c)), ("http://a.com/none", page("fr", "f", "no links"))]
    got, want = of_pages(spark, tmp_path, "page_parse", pages)
    assert got == want and len(got) == 3


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows == sorted(rows, key=lambda r: (-r.score, r.url)) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_and_push(spark):
    plan = crawl_queries.unfetched_score_sum(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    plan = crawl_queries.outlinks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    plan = crawldb.fetch_queue(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type as status", "value as score", "props as url"), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_parse_results_count_failures(spark):
    assert parse.parse(spark.createDataFrame([], "url string, status string, fetched_url string, headers map<string,array<string>>, content binary, content_type string")).count() == 0


def test_crawl_goes_on_where_it_stopped(spark, tmp_path):
    graph = {"d1.com": ["d1.com/a", "d1.com/b"], "d1.com/a": ["d1.com/c", "d2.com/e"], "d1.com/b": ["d1.com/d"], "d1.com/c": [], "d1.com/d": ["d2.com/e"], "d2.com/e": []}
    job = crawl.Crawl(web(spark, graph), default_delay_ms=0, max_rounds=8)
    start = seeds.of_urls(spark, ["http://d1.com"])
    whole = crawl.run(spark, job, start, str(tmp_path / "whole"), 1_000)
    part = crawl.run(spark, job.with_(max_rounds=2), start, str(tmp_path / "part"), 1_000)
    os.remove(os.path.join(part.folder, "round=00002", "states", "_SUCCESS"))  # as if it had been stopped before the end of round 2
    again = crawl.run(spark, job, start, str(tmp_path / "part"), 5_000_000)
    assert again.rounds == whole.rounds > 2
    for name in ("states", "scores"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(whole, name).collect()))
    assert sorted(fetched(again)) == sorted(fetched(whole))


def test_links_are_lengthened_and_pieces_replaced(spark, tmp_path):
    asked, merged = [], []

    def lengthener(requests):
        asked.extend(r.url for r in requests.collect())
        return fetch._filled(requests.select("url", F.lit(301).alias("code"), F.create_map(F.lit("Location"), F.array(F.lit("http://d2.com/long"))).alias("headers")))

    def merger(updates):
        merged.append(1)
        return crawldb.merge(updates)

    graph = {"d1.com": ["bit.ly/x", "d1.com/a"], "d1.com/a": [], "d2.com/long": []}
    job = crawl.Crawl(web(spark, graph), lengthener=lengthener, merger=merger, default_delay_ms=0, max_rounds=3)
    out = crawl.run(spark, job, seeds.of_urls(spark, ["http://d1.com"]), str(tmp_path), 1)
    assert {r.url for r in out.states.filter("status = 'FETCHED'").collect()} == {N(u) for u in graph} and asked == ["http://bit.ly/x"] and len(merged) == out.rounds + 1


def test_crawl_of_a_seed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("http://d1.com\n")
    graph = {"d1.com": ["d1.com/a"], "d1.com/a": [], "d3.com": []}
    job = crawl.Crawl(web(spark, graph), default_delay_ms=0, max_rounds=9)
    for k in range(2):
        query = crawl.follow_seeds(spark, job, seeds.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "crawl"), str(tmp_path / "ck"))
        assert query.awaitTermination(300)
        (tmp_path / "in" / "b.txt").write_text("http://d3.com\n")
    out = crawl.run(spark, job, seeds.of_urls(spark, []), str(tmp_path / "crawl"))
    assert {r.url for r in out.states.filter("status = 'FETCHED'").collect()} == {N(u) for u in graph}


def test_streamed_rules_hold_by_status(spark, tmp_path):
    hour = 3_600_000
    rows = [("o", "a", 0, 0, None), ("o", "r", 10, 1, 500), ("o", "b", hour, 2, None), ("o", "c", hour + 10, 3, None), ("o", "r", hour + 20, 4, 200), ("o", "d", 12 * hour, 5, None), ("o", "e", 13 * hour + 20, 6, None)]
    got = streamed(spark, tmp_path, rows, "origin string, url string, now bigint, seq bigint, code int", "origin", processors.RobotsCache()).collect()
    assert sorted((r.url, r.fetch_rules) for r in got) == [("a", True), ("b", False), ("c", True), ("d", False), ("e", True)]


def test_streamed_queue_keeps_a_url_once(spark, tmp_path):
    rows = [(0, "candidate", "u", 1.0, 0), (0, "candidate", "u", 3.0, 1), (0, "candidate", "v", 2.0, 2)]
    got = streamed(spark, tmp_path, rows, "shard bigint, kind string, url string, score double, seq bigint", "shard", processors.FetchQueue(size=5, most_in_flight=5), parts=1).collect()
    assert [(r.url, r.score) for r in got] == [("u", 3.0), ("v", 2.0)]
