"""Fetching: the politeness gate, the fetch rate, and fetchers over tables, over HTTP and none at all."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlnet.functions import http
from trawlnet.schema import RATE_SECONDS

RESPONSES = "url string, code int, failure string, fetched_url string, headers map<string,array<string>>, content binary, content_type string, response_rate int"


def politeness_gate(requests: DataFrame) -> DataFrame:
    """requests (origin, now, seq, crawl_delay_ms, ...) with `passed` and `next_fetch_time` (null if passed).

    In order of (now, seq), a request that comes before its origin's next fetch time is skipped and leaves it; another passes and sets it to now plus its
    delay. A column `start_time`, where there is one, has the origin's next fetch time beforehand. Each origin is read as a sorted
    stream, so a large one needs no memory.
    """
    begins = "start_time" in requests.columns
    schema = requests.select("*", F.lit(True).alias("passed"), F.lit(None).cast("bigint").alias("next_fetch_time")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, due = None, None
        for batch in batches:
            passed, later = [], []
            starts = batch.column("start_time").to_pylist() if begins else [None] * batch.num_rows
            for name, now, delay, start in zip(batch.column("origin").to_pylist(), batch.column("now").to_pylist(), batch.column("crawl_delay_ms").to_pylist(), starts):
                if name != origin:
                    origin, due = name, start
                if due is not None and now < due:
                    passed.append(False)
                    later.append(due)
                else:
                    due = now + (delay or 0)
                    passed.append(True)
                    later.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed), pa.array(later, pa.int64())], [*batch.schema.names, "passed", "next_fetch_time"])

    return requests.repartition("origin").sortWithinPartitions("origin", "now", "seq").mapInArrow(run, schema)


def fetch_rate(fetches: DataFrame, *keys: str, seconds: int = RATE_SECONDS) -> DataFrame:
    """(keys, second, fetched, rate) for each second with fetches (time_ms): how many, and the mean number a second over the last `seconds`."""
    by_second = fetches.groupBy(*keys, F.floor(F.col("time_ms") / 1000).alias("second")).agg(F.count("*").alias("fetched"))
    window = W.partitionBy(*keys).orderBy("second").rangeBetween(1 - seconds, 0)
    return by_second.withColumn("rate", F.sum("fetched").over(window) / seconds)


@dataclass
class TimedCounter:
    """Counts of the last n seconds, the present one last; time doesn't go back."""

    n: int = RATE_SECONDS
    counts: np.ndarray = field(init=False)
    second: int | None = None

    def __post_init__(self) -> None:
        self.counts = np.zeros(self.n, np.int64)

    def increment(self, time_ms: int) -> None:
        second = time_ms // 1000
        if self.second is None:
            self.second = second
        if second < self.second:
            raise ValueError("time went back")
        moved = min(self.n, second - self.second)
        if moved:
            self.counts = np.r_[self.counts[moved:], np.zeros(moved, np.int64)]
        self.second = second
        self.counts[-1] += 1

    @property
    def total(self) -> int:
        return int(self.counts.sum())


class Fetcher(Protocol):
    """Maps requests (url, ...) to RESPONSES, one for each url."""

    def __call__(self, requests: DataFrame) -> DataFrame: ...


@dataclass
class FetchSettings:
    """What a fetcher takes: media types (none: all), sizes, redirects, connections, pace and time."""

    agent: str = ""
    mime_types: tuple[str, ...] = ()
    max_size: int = 1_000_000
    max_size_by_type: dict[str, int] = field(default_factory=dict)
    max_redirects: int = 20
    follow: str = "all"
    threads: int = 10
    connections_per_host: int = 2
    min_response_rate: int = 0
    accept_language: str = "en-us,en-gb,en;q=0.7,*;q=0.3"
    timeout_s: float = 100.0

    def limit(self, content_type: str) -> int:
        return self.max_size_by_type.get(content_type, self.max_size)


HTML_ONLY = ("text/html", "application/xhtml+xml")


def nothing(requests: DataFrame) -> DataFrame:
    """A fetcher that finds nothing: 404 for every url."""
    return _filled(requests.select("url", F.lit(404).alias("code")))


def _filled(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    kinds = dict(x.rsplit(" ", 1) for x in RESPONSES.split(", "))
    out = {k: (F.col(k) if k in have else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()}
    out["fetched_url"] = F.coalesce(F.col("fetched_url"), F.col("url")).alias("fetched_url") if "fetched_url" in have else F.col("url").alias("fetched_url")
    return rows.select(*out.values())


@dataclass
class TableFetcher:
    """Answers from a table (url, code, content and any more of RESPONSES), a row a URL; a URL that isn't there is not found."""

    pages: DataFrame
    settings: FetchSettings = field(default_factory=FetchSettings)

    def __call__(self, requests: DataFrame) -> DataFrame:
        known = _filled(self.pages).dropDuplicates(["url"])
        rows = requests.select("url").distinct().join(known, "url", "left").withColumn("code", F.when(F.col("code").isNull() & F.col("failure").isNull(), 404).otherwise(F.col("code"))).withColumn("fetched_url", F.coalesce("fetched_url", "url"))
        return limited(rows, self.settings)


def limited(responses: DataFrame, settings: FetchSettings) -> DataFrame:
    """responses, those of another media type or over the size turned to failures without content."""
    kind, found = http.mime_type(F.col("content_type")), F.col("code") == 200
    wrong = found & ~kind.isin(*settings.mime_types) if settings.mime_types else F.lit(False)
    limit = F.lit(settings.max_size)
    for name, most in settings.max_size_by_type.items():
        limit = F.when(kind == name, most).otherwise(limit)
    large = found & F.coalesce(F.octet_length("content") > limit, F.lit(False))
    return responses.withColumns({"failure": F.when(wrong, "mime_type").when(large, "content_size").otherwise(F.col("failure")), "content": F.when(~(wrong | large), F.col("content"))})


@dataclass
class HttpFetcher:
    """Fetches over HTTP in each task's threads. Requests of a host stay in one partition, where no more than connections_per_host of them are under way at once."""

    settings: FetchSettings

    def __post_init__(self) -> None:
        if not self.settings.agent:
            raise ValueError("an HTTP fetcher needs a user agent")

    def __call__(self, requests: DataFrame) -> DataFrame:
        settings = self.settings

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(settings.threads) as pool:
                for batch in batches:
                    found = by_host(list(batch["url"]), lambda u: fetch_one(u, settings), settings.connections_per_host, pool)
                    yield pd.DataFrame(found, columns=[c.split(" ")[0] for c in RESPONSES.split(", ")])

        from trawlnet.functions.urls import host

        return requests.select("url").distinct().repartition(host(F.col("url"))).mapInPandas(run, RESPONSES)


def by_host(wanted: list[str], get: Callable[[str], tuple], most: int, pool: ThreadPoolExecutor) -> list[tuple]:
    """get of every URL, in their order: those of a host form `most` lines, each worked off by one thread at a time, the hosts side by side."""
    lines: dict[tuple[str, int], list[int]] = {}
    met: dict[str, int] = {}
    for k, url in enumerate(wanted):
        name = url.partition("://")[2].partition("/")[0].rpartition("@")[2].lower()
        met[name] = met.get(name, -1) + 1
        lines.setdefault((name, met[name] % max(1, most)), []).append(k)
    out: list[tuple] = [()] * len(wanted)

    def work(line: list[int]) -> None:
        for k in line:
            out[k] = get(wanted[k])

    list(pool.map(work, lines.values()))
    return out


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, follow: str, most: int):
        self.follow, self.max_redirections = follow, most

    def redirect_request(self, req, fp, code, msg, headers, newurl):  # noqa: ANN001, ANN201
        allowed = self.follow == "all" or self.follow == "temporary" and code in (302, 303, 307)
        return super().redirect_request(req, fp, code, msg, headers, newurl) if allowed else None


def fetch_one(url: str, settings: FetchSettings) -> tuple:
    """One response; failures are named, never raised."""
    opener = urllib.request.build_opener(_Redirects(settings.follow, settings.max_redirects))
    none = (None, {}, None, None, None)
    try:
        request = urllib.request.Request(url, headers={"User-Agent": settings.agent, "Accept-Language": settings.accept_language})
        began = time.monotonic()
        with opener.open(request, timeout=settings.timeout_s) as answer:
            kind = answer.headers.get_content_type()
            if settings.mime_types and kind not in settings.mime_types:
                return (url, answer.status, "mime_type", *none)
            parts, size = [], 0
            while part := answer.read(1 << 16):
                parts.append(part)
                size += len(part)
                rate = size / max(1e-3, time.monotonic() - began)
                if size > settings.limit(kind):
                    return (url, answer.status, "content_size", *none)
                if settings.min_response_rate and time.monotonic() - began > 1 and rate < settings.min_response_rate:
                    return (url, answer.status, "slow_response", *none)
            headers = {k: answer.headers.get_all(k) for k in set(answer.headers.keys())}
            return (url, answer.status, None, answer.url, headers, b"".join(parts), answer.headers.get("Content-Type"), int(size / max(1e-3, time.monotonic() - began)))
    except urllib.error.HTTPError as e:
        return (url, e.code, None, None, {k: e.headers.get_all(k) for k in set(e.headers.keys())}, None, None, None)
    except ValueError:
        return (url, None, "url", *none)
    except OSError:
        return (url, None, "io", *none)


def results(requests: DataFrame, responses: DataFrame, now: int | Column) -> DataFrame:
    """FETCH_RESULT rows of requests (url, score) and their responses; a URL without a response failed by input or output."""
    status = F.coalesce(http.status_of_exception(F.col("failure")), http.status_of_code(F.col("code")), F.lit("ERROR_IOEXCEPTION"))
    at = F.lit(now) if isinstance(now, int) else now
    return requests.select("url", "score").join(responses, "url", "left").select(
        "url", "score", status.alias("status"), at.cast("bigint").alias("status_time"), F.coalesce("fetched_url", "url").alias("fetched_url"), "headers", "content", "content_type",
        "response_rate", F.lit(0).cast("bigint").alias("next_fetch_time"),
    )
