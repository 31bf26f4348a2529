"""Robots rules: read per origin, kept until they expire, and applied to requests."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import http, urls
from trawlnet.functions.robots import Rules, failed, parse
from trawlnet.schema import BLOCKED_RETRY_MS, DEFAULT_CRAWL_DELAY_MS, NO_FORCED_DELAY

RULES = "allow string, rules array<struct<allowed:boolean,prefix:string,pattern:string,size:int>>, crawl_delay_ms bigint, sitemaps array<string>, defer boolean"


def _row(rules: Rules) -> tuple:
    out = []
    for allowed, path in rules.rules:
        wild = "*" in path or path.endswith("$")
        body = path[:-1] if path.endswith("$") else path
        pattern = "^" + ".*".join(re.escape(x) for x in body.split("*")) + ("$" if path.endswith("$") else "") if wild else None
        out.append({"allowed": allowed, "prefix": None if wild else path, "pattern": pattern, "size": len(path)})
    return rules.allow, out, rules.crawl_delay_ms, rules.sitemaps, rules.defer


def rules_of(responses: DataFrame, now: int, agent: str = "*") -> DataFrame:
    """(origin, code, RULES, expires_at) of robots responses (origin, code, body); no code counts as 500."""

    @F.pandas_udf(f"struct<{', '.join(RULES.split(', '))}>".replace("struct<allow string", "struct<allow string"))
    def read(codes: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = [_row(parse(b, agent) if c == 200 else failed(int(c))) for c, b in zip(codes, bodies)]
        out = pd.DataFrame(rows, columns=["allow", "rules", "crawl_delay_ms", "sitemaps", "defer"])
        out["crawl_delay_ms"] = out["crawl_delay_ms"].astype("Int64")
        return out

    code = F.coalesce("code", F.lit(500)).cast("int")
    rows = responses.select("origin", code.alias("code"), read(code, F.coalesce("body", F.lit(""))).alias("r"))
    return rows.select("origin", "code", "r.*", (F.lit(now) + http.robots_lifetime_ms(F.col("code"))).alias("expires_at"))


def robots_url(origin: str = "origin"):
    return F.concat(F.col(origin), F.lit("/robots.txt"))


def missing(requests: DataFrame, rules: DataFrame | None, now: int) -> DataFrame:
    """(origin, url of its robots file) of the requests' origins without rules that still hold."""
    wanted = requests.select(urls.origin(F.col("url")).alias("origin")).distinct()
    if rules is not None:
        wanted = wanted.join(rules.filter(F.col("expires_at") > now).select("origin"), "origin", "left_anti")
    return wanted.withColumn("url", robots_url())


def allowed(path, rules):
    """Whether the longest rule that matches allows a path (allowing wins a tie); true if none matches."""
    hit = lambda r: F.when(r["prefix"].isNotNull(), F.startswith(path, r["prefix"])).otherwise(F.regexp_like(path, r["pattern"]))
    best = F.array_max(F.transform(F.filter(rules, hit), lambda r: F.struct(r["size"].alias("size"), r["allowed"].alias("allowed"))))
    return F.coalesce(best["allowed"], F.lit(True))


def gate(requests: DataFrame, rules: DataFrame, now: int, forced_delay_ms: int = NO_FORCED_DELAY, default_delay_ms: int = DEFAULT_CRAWL_DELAY_MS) -> DataFrame:
    """requests (url, score) with `origin`, `outcome` (passed, blocked), `status`, `crawl_delay_ms` and `next_fetch_time`.

    A request without rules passes. A blocked one is SKIPPED_DEFERRED where the visit is put off, else SKIPPED_BLOCKED, with a fetch time far ahead.
    """
    rows = requests.withColumn("origin", urls.origin(F.col("url"))).join(rules.select("origin", "allow", "rules", F.col("crawl_delay_ms").alias("__delay"), "defer"), "origin", "left")
    target = F.concat(F.when(urls.path(F.col("url")) == "", F.lit("/")).otherwise(urls.path(F.col("url"))), F.coalesce(F.concat(F.lit("?"), urls.query(F.col("url"))), F.lit("")))
    ok = F.when(F.col("allow") == "none", F.lit(False)).when(F.col("allow") == "some", allowed(target, F.col("rules"))).otherwise(F.lit(True))
    delay = F.lit(forced_delay_ms) if forced_delay_ms != NO_FORCED_DELAY else F.coalesce("__delay", F.lit(default_delay_ms))
    rows = rows.withColumn("__ok", ok)
    return rows.select(
        *requests.columns, "origin", F.when(F.col("__ok"), "passed").otherwise("blocked").alias("outcome"),
        F.when(~F.col("__ok"), F.when(F.col("defer"), "SKIPPED_DEFERRED").otherwise("SKIPPED_BLOCKED")).alias("status"),
        F.when(F.col("__ok"), delay.cast("bigint")).alias("crawl_delay_ms"), F.when(~F.col("__ok"), F.lit(now + BLOCKED_RETRY_MS)).alias("next_fetch_time"),
    )


def sitemap_requests(fresh_rules: DataFrame) -> DataFrame:
    """(url) of the sitemaps named by rules just fetched, those that are URLs; each once."""
    return fresh_rules.select(F.explode("sitemaps").alias("url")).filter(urls.is_valid(F.col("url"))).distinct()
