"""The `warc` data source: reads WARC files, writes segments that roll over at a size.

`spark.dataSource.register(WarcSource)`, then `spark.read.format("warc").load(path)` or
`df.write.format("warc").option("compression", "gzip").option("maxBytes", n).mode("append").save(path)`.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from trawlnet.functions.warc import Record, read

SCHEMA = "headers array<struct<name:string,value:string>>, content binary"
HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
SEGMENT_BYTES = 1_000_000_000
#: Most records, and bytes of content after which no more are added, of what is held as objects at once.
PIECE_ROWS, PIECE_BYTES = 500, 4_000_000


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI; s3a is s3."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        folder, pattern = (path, "*.warc*") if "*" not in os.path.basename(path) else os.path.split(path)
        names = sorted(i.path for i in system.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch(i.base_name, pattern) and i.base_name[0] not in "._")
        return [_File(p) for p in names]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with located(self.path)[0].open_input_stream(partition.path, compression=None) as raw:
            stream = io.BufferedReader(raw)
            held, size = [], 0
            for record in read(gzip.GzipFile(fileobj=stream) if partition.path.endswith(".gz") else stream):
                held.append(record)
                size += len(record.content)
                if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _batch(records: list[Record]) -> pa.RecordBatch:
    headers = [[{"name": k, "value": v} for k, v in r.headers] for r in records]
    return pa.RecordBatch.from_arrays([pa.array(headers, HEADERS), pa.array([r.content for r in records], pa.binary())], ["headers", "content"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict[str, str]] | None, bytes | None]]:
    """Headers and contents of batches, a row at a time."""
    for batch in batches:
        headers, contents = batch.columns
        for k in range(batch.num_rows):
            yield headers[k].as_py(), contents[k].as_py()


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool, most: int):
        self.path, self.compressed, self.most = path, compressed, most

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        paths, stream, size = [], None, 0
        try:
            for headers, content in _rows(batches):
                if stream is None or size > self.most:  # the record that goes beyond stays
                    if stream:
                        stream.close()
                    name = f"part-{part:05d}-{attempt}-seg-{len(paths):05d}.warc{'.gz' if self.compressed else ''}"
                    paths.append(f"{folder}/.{name}")
                    stream, size = system.open_output_stream(paths[-1], compression=None), 0
                data = Record([(h["name"], h["value"]) for h in headers or []], content or b"").encode()
                data = gzip.compress(data) if self.compressed else data
                stream.write(data)
                size += len(data)
        finally:
            if stream:
                stream.close()
        return _Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            for p in m.paths if m else []:
                folder, name = os.path.split(p)
                system.move(p, f"{folder}/{name[1:]}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = located(self.path)
        for m in messages:
            for p in m.paths if m else []:
                if system.get_file_info(p).type == fs.FileType.File:
                    system.delete_file(p)


class WarcSource(DataSource):
    """Rows (headers, content); path is a folder all executors reach, a file or a pattern, as a path or a URI that pyarrow knows. Segments show up under their names when the whole write is committed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("compression", "none") == "gzip", int(self.options.get("maxbytes", SEGMENT_BYTES)))
