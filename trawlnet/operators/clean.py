"""Raw URLs to crawl states: lengthen, normalise, validate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlnet.functions import shorteners, urls

_SHORT_HOST = r"(?i)^https?://([^/:?]{3,})"


def lengthen(raw: DataFrame, redirects: DataFrame, hosts: tuple[str, ...] = shorteners.BUILT_IN) -> DataFrame:
    """raw (url, score, ...) with short URLs replaced by where they lead; redirects has (url, status, location).

    Of a short host's URLs, one that was found (200) or moved (301) to an absolute URL becomes its location; all others stay.
    """
    short = F.lower(F.regexp_extract("url", _SHORT_HOST, 1)).isin(list(hosts))
    known = redirects.groupBy(F.col("url").alias("__short")).agg(F.min_by(F.struct("status", "location"), F.struct("status", "location")).alias("__to"))
    rows = raw.withColumn("__key", F.when(short, F.col("url"))).join(known, F.col("__key") == F.col("__short"), "left")
    to = F.when(F.col("__to.status").isin(200, 301) & F.col("__to.location").rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/]"), F.col("__to.location"))
    return rows.withColumn("url", F.coalesce(to, "url")).select(*raw.columns)


def normalize(raw: DataFrame, aggressive: bool = False, ref_as_query: bool = False) -> DataFrame:
    return raw.withColumn("url", urls.normalized(F.col("url"), aggressive, ref_as_query))


def validate(raw: DataFrame, now: int | Column, valid: Callable[[Column], Column] = urls.is_valid) -> DataFrame:
    """Crawl states, unfetched, of the raw URLs (url, score) that are valid; the others go."""
    url, none = F.col("url"), F.lit(None)
    return raw.filter(valid(url)).select(
        "url", urls.pld(url).alias("pld"), F.lit("UNFETCHED").alias("status"), none.cast("string").alias("previous_status"),
        (F.lit(now) if isinstance(now, int) else now).cast("bigint").alias("status_time"), F.col("score").cast("double").alias("score"), F.lit(0).cast("bigint").alias("next_fetch_time"),
    )


def clean(raw: DataFrame, now: int | Column, redirects: DataFrame | None = None, normalizer: Callable[[DataFrame], DataFrame] = normalize, valid: Callable[[Column], Column] = urls.is_valid) -> DataFrame:
    """Lengthen (where redirects are given), normalise and validate."""
    if redirects is not None:
        raw = lengthen(raw, redirects)
    return validate(normalizer(raw), now, valid)
