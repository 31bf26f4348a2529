"""Parsing fetched pages: text, title, language, metadata, scored links, and what goes where."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlnet.functions import html, urls
from trawlnet.functions.language import detect
from trawlnet.functions.text import language_code
from trawlnet.schema import MAX_EXTRACTED_LINKS, MAX_OUTLINKS

_LINKS = pa.list_(pa.struct([("url", pa.string()), ("anchor_text", pa.string()), ("rel", pa.string())]))
_OUT = "url string, fetched_url string, title string, language string, parsed_text string, meta map<string,string>, links array<struct<url:string,anchor_text:string,rel:string>>, error string"
#: A page's score from the columns of the parsed pages.
Scorer = Callable[[], Column]


def all_equal() -> Column:
    return F.lit(1.0)


@dataclass(frozen=True)
class ParserSettings:
    """Longest time for a page (at least 100 ms; one that takes longer counts as failed), most links of a page, what counts as a link, and whether the text is the markup itself."""

    max_duration_ms: int = 30_000
    max_links: int = MAX_EXTRACTED_LINKS
    link_tags: frozenset[str] = html.LINK_TAGS
    link_attributes: frozenset[str] = html.LINK_ATTRIBUTES
    markup: bool = False

    def __post_init__(self) -> None:
        if self.max_duration_ms < 100:
            raise ValueError("a page needs 100 ms at least")


def parse(results: DataFrame, scorer: Scorer = all_equal, settings: ParserSettings = ParserSettings()) -> DataFrame:
    """PARSED rows of the fetched results (url, fetched_url, headers, content, content_type, status), and `error` for those that can't be read.

    Each link's score is the page's, divided by its number of links. The scorer may use url, fetched_url, title, language, parsed_text, meta and links.
    """
    rows = results.filter("status = 'FETCHED'").select("url", "fetched_url", F.element_at(F.element_at("headers", "Content-Location"), 1).alias("location"), F.element_at(F.element_at("headers", "Content-Language"), 1).alias("header_language"), "content", "content_type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {k.split(" ")[0]: [] for k in _OUT.split(", ")}
            for url, fetched, location, header, content, kind in zip(*(batch.column(c).to_pylist() for c in ("url", "fetched_url", "location", "header_language", "content", "content_type"))):
                page, error, raw = html.Page(), None, ""
                try:
                    with limited(settings.max_duration_ms):
                        raw = _decoded(content or b"", kind or "")
                        page = html.read(raw, html.urljoin(fetched, location) if location else fetched, settings.link_tags, settings.link_attributes, settings.max_links)
                except Exception as e:  # a page that can't be read is counted, and the others go on
                    error = f"{type(e).__name__}: {e}"
                said = page.meta.get("dc.language") or header or page.meta.get("content-language") or page.language
                code = said[:2].lower() if said and (len(said) <= 2 or said[2] in ",;-") else ""
                values = (url, fetched, page.title, code or detect(page.text), raw if settings.markup else page.text, list(page.meta.items()), [{"url": k.url, "anchor_text": k.anchor_text, "rel": k.rel} for k in page.links], error)
                for c, v in zip(cols.values(), values):
                    c.append(v)
            types = [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), _LINKS, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], list(cols))

    parsed = rows.mapInArrow(run, _OUT).withColumn("score", scorer().cast("double"))
    share = F.col("score") / F.size("links")
    return parsed.withColumn("outlinks", F.transform("links", lambda k: F.struct(k["url"].alias("url"), k["anchor_text"].alias("anchor_text"), k["rel"].alias("rel"), share.alias("score")))).drop("links")


@contextmanager
def limited(ms: int) -> Iterator[None]:
    """Raises TimeoutError in what runs inside for longer than ms. It needs the main thread, where Spark's Python workers run; elsewhere there is no limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(number: int, frame: object) -> None:
        raise TimeoutError(f"over {ms} ms")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, ms / 1000)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _decoded(content: bytes, content_type: str) -> str:
    kind, _, rest = content_type.partition(";")
    charset = rest.partition("charset=")[2].strip(" \"'").split(";")[0]
    try:
        return content.decode(charset or "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def texts(parsed: DataFrame) -> DataFrame:
    """The pages of a score above zero."""
    return parsed.filter("error is null and score > 0")


def domain_scores(parsed: DataFrame, seq: Column) -> DataFrame:
    """(pld, seq, score) of all parsed pages, by the domain that was fetched."""
    return parsed.filter("error is null").select(urls.pld(F.col("fetched_url")).alias("pld"), seq.alias("seq"), "score")


def outlinks(parsed: DataFrame, most: int = MAX_OUTLINKS) -> DataFrame:
    """(page, url, score, anchor_text, rel) of each page's links of the highest scores, of equals the first in the page."""
    ranked = F.array_sort(F.transform("outlinks", lambda k, i: F.struct((-k["score"]).alias("by"), i.alias("at"), k.alias("link"))))
    return parsed.filter("error is null").select(F.col("url").alias("page"), F.explode(F.slice(ranked, 1, most)).alias("k")).select("page", "k.link.url", "k.link.score", "k.link.anchor_text", "k.link.rel")


def top_links(links: DataFrame, most: int) -> DataFrame:
    """The same for rows (page, position, url, score); of links at the same position, as of pages with the same URL, the first by URL."""
    return links.withColumn("__n", F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), "position", "url"))).filter(F.col("__n") <= most).drop("__n")


def raw_urls(links: DataFrame) -> DataFrame:
    return links.select("url", F.col("score").cast("double").alias("score"))


#: Links of well-formed pages in the JVM: what an `<a ... href="...">` has.
_HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)\""""


def quick_links(pages: DataFrame, most: int | None = MAX_EXTRACTED_LINKS) -> DataFrame:
    """(page, position, url, n_links) of pages (url, html), without a Python worker: quoted href of anchors, absolute, each once, the first `most` of a page or, if that is None, all."""
    base = F.col("url")
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_HREF), 1), lambda k: urls.resolved(k, base)))
    found = found if most is None else F.slice(found, 1, most)
    barred = F.col("html").rlike(r"""(?i)<meta\s+name\s*=\s*["']robots["'][^>]*\b(?:none|nofollow)\b""")
    rows = pages.select(F.col("url").alias("page"), F.when(~barred, found).alias("found"))
    return rows.select("page", F.posexplode("found").alias("position", "url"), F.size("found").alias("n_links"))


def quick_title(page: Column) -> Column:
    """Text of the first title element, white space at its ends removed; '' if there is none."""
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))


def quick_language(page: Column) -> Column:
    return F.coalesce(language_code(F.regexp_extract(page, r"""(?is)<html[^>]*\slang\s*=\s*["']?([^"'\s>]*)""", 1)), F.lit(""))
