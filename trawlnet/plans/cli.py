"""Command line of the crawl: python -m trawlnet.plans.cli -seedurls seeds.txt -agent name,mail,site."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from trawlnet.functions import urls
from trawlnet.operators import archive, fetch, parse
from trawlnet.plans import crawl, terminate
from trawlnet.schema import DEFAULT_CRAWL_DELAY_MS, MAX_OUTLINKS, NO_FORCED_DELAY
from trawlnet.sinks import outputs
from trawlnet.sources import archive_index, seeds
from trawlnet.storage import is_written, written

ROBOTS_BYTES = 500 << 10


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawlnet", description="Crawl the web, or an archive of it, in rounds.")
    add = p.add_argument
    add("-agent", help="name,email,website of the crawler")
    add("-seedurls", required=True, help="text file or folder of seed URLs, one a line")
    add("-singledomain", help="stay within this domain")
    add("-forcecrawldelay", type=int, default=NO_FORCED_DELAY, help="ms between fetches of an origin, whatever its rules say")
    add("-defaultcrawldelay", type=int, default=DEFAULT_CRAWL_DELAY_MS, help="ms between fetches where rules say nothing")
    add("-maxcontentsize", type=int, default=1_000_000)
    add("-archive", help="read pages from the archive below this folder instead of the web")
    add("-archiveindex", help="index lines of the archive")
    add("-commoncrawl", help="crawl id: its index lines are those below cc-index/collections/<id>/indexes of the folder that -archive names")
    add("-cachedir", help="folder where the archive's index is kept as a table after it was first read")
    add("-parallelism", type=int, help="partitions of a shuffle")
    add("-fetcherspertask", type=int, default=10)
    add("-shards", type=int, default=1, help="fetch queues")
    add("-queuesize", type=int, default=10_000)
    add("-minscore", type=float, default=0.0)
    add("-warccontentpath")
    add("-textcontentfile")
    add("-checkpointdir")
    add("-htmlonly", action="store_true")
    add("-nolengthen", action="store_true")
    add("-maxoutlinks", type=int, default=MAX_OUTLINKS)
    add("-maxduration", type=float, help="seconds")
    add("-maxrounds", type=int, default=100)
    add("-timeout", type=float, default=100.0, help="seconds for a fetch")
    return p


def agent(value: str) -> str:
    """The User-Agent header of name,email,website."""
    parts = [x.strip() for x in value.split(",")]
    if len(parts) != 3 or "@" not in parts[1] or not parts[2].startswith("http"):
        raise ValueError("-agent takes name,email,website")
    return f"Mozilla/5.0 (compatible; {parts[0]}/1.0; +{parts[2]}; {parts[1]})"


def checked(args: argparse.Namespace) -> argparse.Namespace:
    if bool(args.archive) == bool(args.agent):
        raise ValueError("give -agent for the web or -archive for an archive, not both")
    if args.archiveindex and args.commoncrawl:
        raise ValueError("give -archiveindex or -commoncrawl, not both")
    if bool(args.archive) != bool(args.archiveindex or args.commoncrawl):
        raise ValueError("-archive goes with -archiveindex or -commoncrawl")
    if args.parallelism is not None and args.parallelism < 1:
        raise ValueError("-parallelism must be positive")
    return args


def plan(spark: SparkSession, args: argparse.Namespace) -> crawl.Crawl:
    """The crawl that the options describe."""
    types = fetch.HTML_ONLY if args.htmlonly else ()
    if args.archive:
        settings = fetch.FetchSettings(mime_types=types, max_size=args.maxcontentsize)
        index = _index(spark, args).selectExpr("*", "offset as position")
        pages = lambda requests: archive.archived(requests, index, args.archive, settings)
        others = {}
    else:
        name = agent(args.agent)
        settings = fetch.FetchSettings(agent=name, mime_types=types, max_size=args.maxcontentsize, threads=args.fetcherspertask, timeout_s=args.timeout)
        pages = fetch.HttpFetcher(settings)
        few = max(1, args.fetcherspertask // 5)
        lengthener = None if args.nolengthen else fetch.HttpFetcher(fetch.FetchSettings(agent=name, max_redirects=0, follow="none", threads=few, timeout_s=args.timeout))
        others = {"lengthener": lengthener, "robots_fetcher": fetch.HttpFetcher(fetch.FetchSettings(agent=name, max_size=ROBOTS_BYTES, threads=few)), "sitemap_fetcher": fetch.HttpFetcher(fetch.FetchSettings(agent=name, max_size=50 << 20, threads=few))}
    ends = (terminate.after_seconds(args.maxduration),) if args.maxduration else ()
    valid = (lambda u: urls.is_within(u, args.singledomain)) if args.singledomain else urls.is_valid
    return crawl.Crawl(
        pages, agent=args.agent.split(",")[0] if args.agent else "*", valid=valid, queue_size=args.queuesize, min_score=args.minscore, shards=args.shards, forced_delay_ms=args.forcecrawldelay,
        default_delay_ms=args.defaultcrawldelay, max_outlinks=args.maxoutlinks, text_path=args.textcontentfile, warc_path=args.warccontentpath, terminators=ends, max_rounds=args.maxrounds, **others,
    )


def _index(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The archive's index lines; with -cachedir from the table kept there, which is made first where there is none."""
    lines = args.archiveindex or f"{args.archive.rstrip('/')}/cc-index/collections/{args.commoncrawl}/indexes/cdx-*"
    if not args.cachedir:
        return archive_index.read_cdx(spark, lines)
    table = f"{args.cachedir.rstrip('/')}/{(args.commoncrawl or 'index')}.parquet"
    return spark.read.parquet(table) if is_written(spark, table) else written(archive_index.read_cdx(spark, lines), table)


def main(argv: list[str] | None = None) -> None:
    args = checked(parser().parse_args(argv))
    builder = SparkSession.builder.appName("trawlnet")
    if args.checkpointdir:
        builder = builder.config("spark.checkpoint.dir", args.checkpointdir)
    if args.parallelism:
        builder = builder.config("spark.sql.shuffle.partitions", str(args.parallelism))
    spark = builder.getOrCreate()
    outcome = crawl.run(spark, plan(spark, args), seeds.read(spark, args.seedurls))
    if not args.textcontentfile:
        outputs.print_text(parse.texts(outcome.parsed))
    for name, value in sorted(crawl.metrics(outcome).items()):
        print(name, value)


if __name__ == "__main__":
    main()
