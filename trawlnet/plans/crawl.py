"""The crawl as rounds over a persisted table of states.

A streaming graph has no cycles, so the two loops of a crawl, of states and of domain scores, are rounds: a round reads the states, queues the
best unfetched URLs, asks robots rules and politeness, fetches, parses, merges what came of it and writes the states of the next
round. Each round's tables are Parquet below one shared folder, so no lineage outlives a round, and a crawl that was stopped goes on from the last round whose states were written.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet import schema
from trawlnet.functions import shorteners, urls
from trawlnet.operators import clean, crawldb, fetch, parse, robots, sitemap
from trawlnet.plans.terminate import Terminator, nothing_left
from trawlnet.sinks import outputs
from trawlnet.streaming.processors import each_batch
from trawlnet.storage import is_written, new_folder, written

#: Agent name of an example; a crawl over HTTP must have its own.
PLACEHOLDER_AGENT = "unnamed-crawler"


@dataclass(frozen=True)
class Crawl:
    """What a crawl does. Fetchers map requests (url) to responses; redirects, if given, is the table that short URLs are looked up in, and lengthener, if given, a fetcher
    that follows nothing, which is asked about short URLs whenever seeds, links or sitemaps bring any. merger, queue, page_parser, robots_parser and sitemap_parser stand for crawldb.merge,
    crawldb.fetch_queue, parse.parse (of results), robots.rules_of and sitemap.expand.
    """

    page_fetcher: fetch.Fetcher
    robots_fetcher: fetch.Fetcher = fetch.nothing
    sitemap_fetcher: fetch.Fetcher = fetch.nothing
    agent: str = "*"
    job_name: str = "crawl"
    redirects: DataFrame | None = None
    lengthener: fetch.Fetcher | None = None
    short_hosts: tuple[str, ...] = shorteners.BUILT_IN
    merger: Callable[[DataFrame], DataFrame] = crawldb.merge
    queue: Callable[..., DataFrame] = crawldb.fetch_queue
    page_parser: Callable[[DataFrame], DataFrame] | None = None
    robots_parser: Callable[..., DataFrame] = robots.rules_of
    sitemap_parser: Callable[[DataFrame], DataFrame] = sitemap.expand
    normalizer: Callable[[DataFrame], DataFrame] = clean.normalize
    valid: Callable[[Column], Column] = urls.is_valid
    scorer: parse.Scorer = parse.all_equal
    parser: parse.ParserSettings = field(default_factory=parse.ParserSettings)
    queue_size: int = schema.QUEUE_SIZE
    min_score: float = 0.0
    shards: int = 1
    forced_delay_ms: int = schema.NO_FORCED_DELAY
    default_delay_ms: int = schema.DEFAULT_CRAWL_DELAY_MS
    max_outlinks: int = schema.MAX_OUTLINKS
    round_ms: int = 1000
    paced: bool = True
    recrawl: bool = False
    text_path: str | None = None
    warc_path: str | None = None
    terminators: tuple[Terminator, ...] = ()
    max_rounds: int = 100

    def __post_init__(self) -> None:
        if self.agent == PLACEHOLDER_AGENT:
            raise ValueError("the crawl needs a user agent of its own")
        if self.queue_size < 1 or self.shards < 1 or self.max_rounds < 0:
            raise ValueError("queue size and shards must be positive")

    def with_(self, **changes) -> Crawl:  # noqa: ANN003
        return replace(self, **changes)


@dataclass
class Outcome:
    """Tables of a finished crawl: states, parsed pages, domain scores and the event log (round, stage, url, status)."""

    states: DataFrame
    parsed: DataFrame
    scores: DataFrame
    events: DataFrame
    rounds: int
    folder: str


#: The stages of a round and what flows between them, feedback last.
STAGES = (
    ("seeds", "clean"), ("clean", "states"), ("states", "queue"), ("queue", "robots"), ("robots", "politeness"), ("robots", "sitemaps"), ("politeness", "fetch"), ("fetch", "parse"), ("fetch", "warc"),
    ("parse", "text"), ("parse", "scores"), ("parse", "clean"), ("sitemaps", "clean"), ("fetch", "states"), ("robots", "states"), ("scores", "queue"),
)


def dot(crawl: Crawl) -> str:
    """The round as a Graphviz graph; edges that lead to the next round are dashed."""
    order = {name: k for k, name in enumerate(dict.fromkeys(x for edge in STAGES for x in edge))}
    lines = [f'  "{a}" -> "{b}"{" [style=dashed]" if order[b] <= order[a] else ""};' for a, b in STAGES if b != "warc" or crawl.warc_path]
    return f'digraph "{crawl.job_name}" {{\n' + "\n".join(lines) + "\n}\n"


def _log(stage: str, rows: DataFrame, status: Column | None = None) -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), "url", (F.lit(None) if status is None else status).cast("string").alias("status"))


def run(spark: SparkSession, crawl: Crawl, seeds: DataFrame, folder: str | None = None, start_ms: int | None = None, more_seeds: bool = False) -> Outcome:
    """Crawl from seeds (url, score) until nothing is left to fetch, a terminator says so, or the rounds are used up.

    Where folder holds rounds of a crawl it goes on after the last whose states were written, at the time of the first start; seeds are added then
    only if more_seeds is set. What a round that wasn't finished had written is written again.
    """
    folder = folder or new_folder(spark, crawl.job_name)
    at = lambda r, name: os.path.join(folder, f"round={r:05d}", name)
    rules = due = scores = None
    parsed_parts, event_parts = [], []
    r = 0
    if is_written(spark, at(0, "states")):
        while is_written(spark, at(r + 1, "states")):
            r += 1
            parsed_parts.append(spark.read.parquet(at(r, "parsed")))
            event_parts.append(spark.read.parquet(at(r, "events")))
        start = spark.read.parquet(at(0, "start")).first()[0]
        states = spark.read.parquet(at(r, "states"))
        if r:
            rules = spark.read.parquet(at(r, "rules_all") if is_written(spark, at(r, "rules_all")) else at(r, "rules"))
            due, scores = spark.read.parquet(at(r, "asked_due")), spark.read.parquet(at(r, "scores"))
        if more_seeds:
            now = start + r * crawl.round_ms
            first = clean.clean(seeds, now, _redirects(crawl, seeds, new_folder(spark, "short")), crawl.normalizer, crawl.valid)
            states = written(crawl.merger(states.withColumn("seq", F.lit(0)).unionByName(first.withColumn("seq", F.lit(1)))), new_folder(spark, "seeded"))
    else:
        start = int(time.time() * 1000) if start_ms is None else start_ms
        written(spark.createDataFrame([(start,)], "start bigint"), at(0, "start"))
        first = clean.clean(seeds, start, _redirects(crawl, seeds, at(0, "short")), crawl.normalizer, crawl.valid)
        states = written(crawl.merger(first.withColumn("seq", F.lit(0))), at(0, "states"))
    began = time.monotonic()
    while r < crawl.max_rounds and not any(t(r, time.monotonic() - began, states) for t in crawl.terminators):
        r += 1
        now = start + r * crawl.round_ms
        queue = written(_queue(crawl, states, scores, now), at(r, "queue"))
        if nothing_left(queue):
            r -= 1
            break
        rules, fresh = _rules(spark, crawl, queue, rules, now, at(r, "rules"))
        gated = written(robots.gate(queue.select("url", "score"), rules, now, crawl.forced_delay_ms, crawl.default_delay_ms), at(r, "gated"))
        asked, due = _polite(gated.filter("outcome = 'passed'"), due, now, at(r, "asked"))
        passed = asked.filter("passed")
        results = written(fetch.results(passed, crawl.page_fetcher(passed.select("url")), now + 1), at(r, "results"))
        parsed = written(crawl.page_parser(results) if crawl.page_parser else parse.parse(results, crawl.scorer, crawl.parser), at(r, "parsed"))
        maps = crawl.sitemap_parser(fetch.results(robots.sitemap_requests(fresh).withColumn("score", F.lit(1.0)), crawl.sitemap_fetcher(robots.sitemap_requests(fresh)), now))
        links = parse.raw_urls(parse.outlinks(parsed, crawl.max_outlinks))
        raw = written(links.unionByName(maps), at(r, "raw"))
        found = clean.clean(raw, now, _redirects(crawl, raw, at(r, "short")), crawl.normalizer, crawl.valid)
        ended = (
            gated.filter("outcome = 'blocked'").select("url", "status", F.lit(now + 1).alias("status_time"), "score", "next_fetch_time")
            .unionByName(asked.filter("not passed").select("url", F.lit("SKIPPED_CRAWLDELAY").alias("status"), F.lit(now + 1).alias("status_time"), "score", "next_fetch_time"))
            .unionByName(results.select("url", "status", "status_time", F.lit(0.0).alias("score"), "next_fetch_time"))
        )
        updates = (
            states.withColumn("seq", F.lit(0))
            .unionByName(crawldb.checked(ended.select("url", urls.pld(F.col("url")).alias("pld"), "status", F.lit("FETCHING").alias("previous_status"), "status_time", "score", "next_fetch_time", F.lit(1).alias("seq"))))
            .unionByName(found.withColumn("seq", F.lit(2)))
        )
        events = (
            _log("queue", queue, F.lit("FETCHING")).unionByName(_log("robots", gated, F.col("outcome"))).unionByName(_log("fetch", asked)).unionByName(_log("states", ended, F.col("status")))
            .unionByName(_log("parse", parsed)).unionByName(_log("sitemap", robots.sitemap_requests(fresh)))
        )
        event_parts.append(written(events.withColumn("round", F.lit(r)), at(r, "events")))
        more = parse.domain_scores(parsed, F.struct(F.lit(r).alias("round"), F.col("fetched_url").alias("url")))
        scores = written(more if scores is None else crawl_window(scores.unionByName(more)), at(r, "scores"))
        if crawl.warc_path:
            outputs.write_warc(results, crawl.warc_path)
        states = written(crawl.merger(updates), at(r, "states"))
        parsed_parts.append(parsed)
    every = _union(parsed_parts, lambda: spark.createDataFrame([], "url string, fetched_url string, title string, language string, parsed_text string, meta map<string,string>, error string, score double"))
    if crawl.text_path:
        outputs.write_text(parse.texts(every) if parsed_parts else every, crawl.text_path)
    empty_events = lambda: spark.createDataFrame([], "stage string, url string, status string, round int")
    return Outcome(states, every, scores if scores is not None else spark.createDataFrame([], "pld string, seq int, score double"), _union(event_parts, empty_events), r, folder)


def follow_seeds(spark: SparkSession, crawl: Crawl, seeds: DataFrame, folder: str, checkpoint: str, available_now: bool = True):  # noqa: ANN201
    """Crawl from a stream of seeds (url, score): each of its batches is added to the states in folder, and rounds follow until nothing is left. The stream's query."""

    def batch(more: DataFrame, number: int) -> None:
        done = os.path.join(folder, "batches", str(number))  # a batch that comes again after a failure isn't added again
        if not is_written(spark, done):
            run(spark, crawl, more, folder, more_seeds=True)
            written(spark.createDataFrame([(number,)], "batch bigint"), done)

    return each_batch(seeds, checkpoint, batch, available_now)


def _redirects(crawl: Crawl, raw: DataFrame, path: str) -> DataFrame | None:
    """(url, status, location) of short URLs: those given, and those that the lengthener was asked about."""
    if crawl.lengthener is None:
        return crawl.redirects
    short = raw.select("url").filter(F.lower(urls.host(F.col("url"))).isin(list(crawl.short_hosts))).distinct()
    answers = crawl.lengthener(short)
    found = written(answers.select("url", F.col("code").cast("int").alias("status"), F.coalesce(F.element_at(F.element_at("headers", "Location"), 1), "fetched_url").alias("location")), path)
    return found if crawl.redirects is None else found.unionByName(crawl.redirects.select("url", F.col("status").cast("int").alias("status"), "location"))


def _union(parts: list[DataFrame], empty: Callable[[], DataFrame]) -> DataFrame:
    if not parts:
        return empty()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def crawl_window(scores: DataFrame, n: int = schema.MOVING_AVERAGE) -> DataFrame:
    """Each domain's last n scores: all that its moving average needs."""
    from pyspark.sql import Window as W

    return scores.withColumn("__n", F.row_number().over(W.partitionBy("pld").orderBy(F.desc("seq")))).filter(F.col("__n") <= n).drop("__n")


def _queue(crawl: Crawl, states: DataFrame, scores: DataFrame | None, now: int) -> DataFrame:
    candidates = states
    if crawl.recrawl:
        again = (F.col("status") == "FETCHED") | ((F.col("status") == "SKIPPED_CRAWLDELAY") & (F.col("next_fetch_time") <= now))
        candidates = states.withColumn("status", F.when(again & (F.col("next_fetch_time") <= now), "UNFETCHED").otherwise(F.col("status")))
    if crawl.paced and scores is not None:
        means = scores.groupBy("pld").agg(F.greatest(F.lit(schema.MIN_DOMAIN_SCORE), F.avg("score")).alias("score"))
        ready = candidates.filter((F.col("status") == "UNFETCHED") & (F.col("score") >= crawl.min_score))
        candidates = crawldb.within_quota(ready, crawldb.check_intervals(means), crawl.round_ms)
    shard = F.pmod(F.xxhash64("pld"), F.lit(crawl.shards)) if crawl.shards > 1 else None
    return crawl.queue(candidates, crawl.queue_size, crawl.min_score, shard).select("url", "score", "rank")


def _rules(spark: SparkSession, crawl: Crawl, queue: DataFrame, rules: DataFrame | None, now: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules that hold now, and those just fetched."""
    wanted = robots.missing(queue, rules, now)
    answers = crawl.robots_fetcher(wanted.select("url"))
    body = F.decode("content", "UTF-8")
    responses = wanted.join(answers.select("url", F.when(F.col("failure").isNull(), F.col("code")).alias("code"), body.alias("body")), "url", "left")
    fresh = written(crawl.robots_parser(responses.select("origin", "code", "body"), now, crawl.agent), path)
    if rules is None:
        return fresh, fresh
    return written(rules.filter(F.col("expires_at") > now).unionByName(fresh), path + "_all"), fresh


def _polite(passed: DataFrame, due: DataFrame | None, now: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests through the politeness gate, in order of score, and each origin's next fetch time after them."""
    from pyspark.sql import Window as W

    rows = passed.drop("status", "outcome", "next_fetch_time").withColumns({"now": F.lit(now), "seq": F.row_number().over(W.partitionBy("origin").orderBy(F.desc("score"), "url"))})
    if due is not None:
        rows = rows.join(due.withColumnRenamed("due", "start_time"), "origin", "left")
    asked = written(fetch.politeness_gate(rows).drop("start_time"), path)
    times = asked.filter("passed").select("origin", (F.col("now") + F.col("crawl_delay_ms")).alias("due"))
    times = times if due is None else times.unionByName(due)
    return asked, written(times.groupBy("origin").agg(F.max("due").alias("due")), path + "_due")


def metrics(outcome: Outcome) -> dict[str, int]:
    """Counts at the end of a crawl."""
    statuses = {r[0]: r[1] for r in crawldb.status_counts(outcome.states).collect()}  # one row a status
    read, failed = outcome.parsed.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    domains = outcome.states.agg(F.approx_count_distinct("pld")).first()[0]
    return {"pages_parsed": read, "pages_failed": failed, "domains": domains, **{f"status.{k}": v for k, v in statuses.items()}}
