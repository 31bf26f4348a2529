"""What a crawl leaves: lines of text, WARC records."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlnet.functions.text import one_line
from trawlnet.sources.warc import HEADERS, PIECE_ROWS, SCHEMA, WarcSource

_EPOCH = datetime(1970, 1, 1)


def text_lines(parsed: DataFrame) -> DataFrame:
    """(value) a line `url<TAB>text` for each parsed page (url, parsed_text, score) of a score above zero."""
    return parsed.filter("score > 0").select(F.concat_ws("\t", "url", one_line(F.coalesce("parsed_text", F.lit("")))).alias("value"))


def print_text(parsed: DataFrame) -> None:
    """The lines of text to standard output, one after another, as they come from the tasks' partitions."""
    for row in text_lines(parsed).toLocalIterator():
        print(row.value)


def write_text(parsed: DataFrame, path: str) -> None:
    text_lines(parsed).write.mode("overwrite").text(path)


def warc_records(results: DataFrame, software: str = "trawlnet", agent: str = "") -> DataFrame:
    """(headers, content): a warcinfo record for each partition, then a resource record for each fetched page."""
    rows = results.filter("status = 'FETCHED'").select("fetched_url", F.col("status_time").alias("at"), "content_type", "content")

    def record(heads: list[list[tuple[str, str]]], contents: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([[{"name": k, "value": v} for k, v in h] for h in heads], HEADERS), contents], ["headers", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            contents = pc.fill_null(batch.column("content"), b"")  # handed on as they are, not held as objects
            for k in range(0, batch.num_rows, PIECE_ROWS):
                heads = []
                for url, at, kind in zip(*(batch.column(c).slice(k, PIECE_ROWS).to_pylist() for c in ("fetched_url", "at", "content_type"))):
                    date = (_EPOCH + timedelta(milliseconds=int(at))).strftime("%Y-%m-%dT%H:%M:%SZ")
                    if first:
                        info = f"software: {software}\r\nformat: WARC File Format 1.0\r\nhttp-header-user-agent: {agent}\r\n".encode()
                        yield record([[("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]], pa.array([info], contents.type))
                        first = False
                    heads.append([("WARC-Type", "resource"), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", f"<{url}>"), ("Content-Type", kind or "application/octet-stream")])
                yield record(heads, contents.slice(k, PIECE_ROWS))

    return rows.mapInArrow(run, SCHEMA)


def write_warc(results: DataFrame, path: str, compressed: bool = True, **settings: str) -> None:
    results.sparkSession.dataSource.register(WarcSource)
    warc_records(results).write.format("warc").option("compression", "gzip" if compressed else "none").options(**settings).mode("append").save(path)
