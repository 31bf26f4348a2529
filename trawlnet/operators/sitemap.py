"""Sitemaps: the URLs they list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.schema import DEFAULT_SCORE


def expand(results: DataFrame) -> DataFrame:
    """(url, score) of the URLs in fetched sitemaps (status, content): `<loc>` of XML, a line of text; an index of sitemaps, and one that failed, give none."""
    text = F.decode("content", "UTF-8")
    xml = F.ltrim(F.regexp_replace(text, "^\\uFEFF", "")).startswith("<")
    index = text.rlike(r"(?i)<(?:\w+:)?sitemapindex[\s>]")
    locations = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<(?:\w+:)?loc\s*>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda u: F.trim(u))
    found = F.when(~xml, lines).when(~index, locations)
    return results.filter("status = 'FETCHED' and content is not null").select(F.explode(found).alias("url")).filter("url <> ''").withColumn("score", F.lit(DEFAULT_SCORE))
