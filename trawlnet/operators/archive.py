"""Looking pages up in a crawl archive: which index segment, which capture, where redirects lead, and the stored bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlnet.functions import http, urls
from trawlnet.functions.warc import http_parts, opened, read
from trawlnet.operators.fetch import FetchSettings
from trawlnet.sources.warc import located
from trawlnet.storage import new_folder, written

_TEXTUAL = ("text/html", "text/plain", "application/xhtml+xml", "text/xml", "application/xml")
_TEMPORARY, _REDIRECTS = (302, 303, 307), (301, 302, 303, 307)


def floor_lookup(probes: DataFrame, index: DataFrame, ranges: int | None = None) -> DataFrame:
    """probes (key, ...) with a struct `entry` of the index row of the greatest key not above the probe's (null before the first).

    The keys are cut into ranges at a sample of the index of fixed size. Each range gets the entry that holds at its
    beginning from a table of one row a range, so the ranges are searched apart from one another, each in one sorted pass.
    """
    spark = probes.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted(r[0] for r in index.select("key").orderBy(F.xxhash64("key")).limit(20 * n).collect())
    cuts = sorted({sample[k * len(sample) // n] for k in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array([c.encode() for c in cuts], object), np.array([k.encode() for k in keys], object), "right") if cuts else np.zeros(len(keys), int))

    fields = [c for c in index.columns]
    entries = index.select(part("key").alias("__part"), "key", F.struct(*fields).alias("entry"))
    last = entries.groupBy("__part").agg(F.max_by("entry", "key").alias("entry"))
    every = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__part")).join(last, "__part", "left")
    carried = every.withColumn("entry", F.last("entry", True).over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)))  # a row a range
    none = F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("p")).schema["p"].dataType)
    rows = (
        entries.select("__part", "key", F.lit(1).alias("kind"), "entry", none.alias("probe"))
        .unionByName(carried.select("__part", F.lit("").alias("key"), F.lit(0).alias("kind"), "entry", none.alias("probe")))
        .unionByName(probes.filter("key is not null").select(part("key").alias("__part"), "key", F.lit(2).alias("kind"), F.lit(None).cast(entries.schema["entry"].dataType).alias("entry"), F.struct(*probes.columns).alias("probe")))
    )
    window = W.partitionBy("__part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("entry", F.last("entry", True).over(window)).filter("kind = 2").select("probe.*", "entry")


def best_capture(requests: DataFrame, cdx: DataFrame) -> DataFrame:
    """requests (url, ...) with a struct `capture` of the index row to read: same key and protocol; a found page before others, then the latest, of equals the first by position. Null if there is none.

    cdx has key, timestamp, url, status, mime, filename, offset, length and, to break ties, position.
    """
    wanted = requests.select("url").distinct().select("url", urls.archive_key(F.col("url")).alias("key"), urls.protocol(F.col("url")).alias("protocol"))
    rows = cdx.select("key", urls.protocol(F.col("url")).alias("protocol"), F.struct((F.col("status") == 200).alias("found"), "timestamp", (-F.col("position")).alias("first"), F.struct(*cdx.columns).alias("row")).alias("c"))
    best = wanted.join(rows, ["key", "protocol"]).groupBy("url").agg(F.max("c").alias("c")).select("url", F.col("c.row").alias("capture"))
    return requests.join(best, "url", "left")


def follow(requests: DataFrame, hops: DataFrame, policy: str = "all", most: int = 20) -> DataFrame:
    """(url, final_url, code, n_redirects, failure) of requests (url) over known answers hops (url, code, location).

    Of 301, 302, 303 and 307 the policy (none, temporary, all) says which are followed, at most `most` times; a relative location is resolved on the URL that
    answered. A URL without an answer ends in 404. A hop is written before the next, which has only what goes on; when nothing does, that's the end.
    """
    spark = requests.sparkSession
    allowed = {"none": (), "temporary": _TEMPORARY, "all": _REDIRECTS}[policy]
    known = hops.groupBy("url").agg(F.min(F.struct("code", "location")).alias("a")).select(F.col("url").alias("final_url"), "a.code", "a.location")
    at = requests.select("url").distinct().withColumns({"final_url": F.col("url"), "n_redirects": F.lit(0)})
    done = None
    for step in range(most + 1):
        seen = written(at.join(known, "final_url", "left").withColumn("code", F.coalesce("code", F.lit(404))), new_folder(spark, "follow"))
        goes_on = F.col("code").isin(*allowed) & F.col("location").isNotNull() if allowed else F.lit(False)
        failure = F.when(goes_on, F.lit("too_many_redirects")) if step == most else F.when(F.lit(False), F.lit(""))
        if step < most:
            failure = F.when((F.col("code") == 301) & ~goes_on, "permanent_redirect").when(F.col("code") == 303, "see_other").when(F.col("code").isin(302, 307), "temporary_redirect")
        ended = seen if step == most else seen.filter(~goes_on)
        ended = ended.select("url", "final_url", "code", "n_redirects", failure.cast("string").alias("failure"))
        done = ended if done is None else done.unionByName(ended)
        if step == most or seen.filter(goes_on).isEmpty():
            break
        at = seen.filter(goes_on).select("url", urls.resolved(F.col("location"), F.col("final_url")).alias("final_url"), (F.col("n_redirects") + 1).alias("n_redirects"))
    return done


def archived(requests: DataFrame, cdx: DataFrame, root: str, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """RESPONSES of requests (url) from an archive: its index and, below `root`, the record files, read by range and sorted by file.

    A page of another media type than wanted, and one cut off that isn't textual, is a failure; what the index lacks is not found.
    Redirects are followed along the index as far as settings say, with the location that the stored answer names. Each hop's requests are written, so
    that few of them are sent to the index instead of moving it.
    """
    spark = requests.sparkSession
    out = None
    at = requests.select("url").distinct().withColumn("target", F.col("url"))
    follows = {"none": (), "temporary": _TEMPORARY, "all": _REDIRECTS}[settings.follow]
    for step in range(settings.max_redirects + 1):
        found = best_capture(at.select(F.col("target").alias("url")), cdx).withColumnRenamed("url", "target").dropDuplicates(["target"])
        wanted = F.col("capture.mime").isin(*settings.mime_types) if settings.mime_types else F.lit(True)
        kind = F.when(F.col("capture").isNull(), "absent").when((F.col("capture.status") == 200) & ~wanted, "mime_type").otherwise("read")
        marked = found.withColumn("kind", kind)
        stored = _records(marked.filter("kind = 'read'").select("target", "capture.filename", "capture.offset", "capture.length"), root)
        rows = at.join(marked.select("target", "kind"), "target", "left").join(stored, "target", "left")
        rows = written(rows, new_folder(spark, "archived"))
        again = rows.filter(F.col("code").isin(*follows) & F.col("location").isNotNull()) if follows else rows.filter("false")
        last = step == settings.max_redirects or not again.take(1)
        ended = rows if last else rows.join(again.select("url"), "url", "left_anti")
        cut = F.col("truncated") & ~http.mime_type(F.col("content_type")).isin(*_TEXTUAL)
        nowhere = F.col("code").isin(*_REDIRECTS) & F.col("location").isNull()
        failure = F.when(F.col("kind") == "mime_type", "mime_type").when(cut, "content_size").when(nowhere & (F.col("code") == 301), "permanent_redirect").when(nowhere & (F.col("code") == 303), "see_other").when(nowhere, "temporary_redirect")
        if follows:
            failure = failure.when(F.col("code").isin(*follows), "too_many_redirects")
        ended = ended.select("url", F.when(F.col("kind") == "absent", 404).otherwise(F.col("code")).cast("int").alias("code"), failure.alias("failure"), F.col("target").alias("fetched_url"), "headers", "content", "content_type", F.lit(None).cast("int").alias("response_rate"))
        out = ended if out is None else out.unionByName(ended)
        if last:
            return out
        at = written(again.select("url", urls.normalized(urls.resolved(F.col("location"), F.col("target"))).alias("target")), new_folder(spark, "archived"))
    return out


def _records(wanted: DataFrame, root: str) -> DataFrame:
    """(target, code, location, headers, content, content_type, truncated) of the records at (filename, offset, length)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = located(root)
        for batch in batches:
            out = []
            for target, name, offset, length in batch.itertuples(index=False):
                with system.open_input_file(f"{base}/{name}") as file:
                    file.seek(int(offset))
                    record = next(read(io.BytesIO(opened(file.read(int(length))))))
                code, head, content = http_parts(record.content)
                headers: dict[str, list[str]] = {}
                for k, v in head:
                    headers.setdefault("-".join(w.capitalize() for w in k.split("-")), []).append(v)
                first = lambda k: (headers.get(k) or [None])[0]  # noqa: E731, B023
                out.append((target, code, first("Location"), headers, content, first("Content-Type"), record.get("WARC-Truncated") is not None))
            yield pd.DataFrame(out, columns=["target", "code", "location", "headers", "content", "content_type", "truncated"])

    schema = "target string, code int, location string, headers map<string,array<string>>, content binary, content_type string, truncated boolean"
    return wanted.repartition("filename").sortWithinPartitions("filename", "offset").mapInPandas(run, schema)
