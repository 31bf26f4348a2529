"""Session settings and packed exchanges that the operators of this subpackage share.

An operator that counts or joins billions of tokens doesn't make a Spark row of each. A Python worker
packs the values bound for one bucket into a few binary columns; Spark exchanges those rows by bucket, and the
worker that owns a bucket sees all of it. Buckets are as many as `spark.sql.shuffle.partitions`, so a larger
input is cut finer by the setting that sizes every other exchange.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import release_memory

#: Values that a worker gathers before it sends them to their buckets.
FLUSH = 1 << 19
#: Row keys (16 bytes each) that are sent to every executor.
KEYS_AT_ONCE = 2_000_000
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; on one machine, where that is unset, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    have = spark.sparkContext.getCheckpointDir()
    if named and not have:
        spark.sparkContext.setCheckpointDir(named)
    elif not have:
        if not re.fullmatch(r"local(\[[\w*,]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trawlnet-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """DataFrames made inside give up their shuffle files as soon as they have been run."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, without the lineage and the shuffle files that made them."""
    ensure_checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Remove the files of a checkpointed df that nothing will read again."""
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        remove(df.sparkSession, path.get())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def buckets(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange(df: DataFrame, bucket: str = "bucket", n: int | None = None) -> DataFrame:
    """Rows moved so that partition b holds just the rows of bucket b."""
    return df.repartitionById(n or buckets(df.sparkSession), F.col(bucket))


def joined(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose small batches go to Spark many at a time: each that is sent takes about a millisecond."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20 or len(held) == 1024:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    return out


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs, the lowest bytes of all first."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def packed_rising(x: np.ndarray) -> bytes:
    """The same for numbers that rise, by their differences."""
    x = np.ascontiguousarray(x, np.uint64)
    return x[:1].tobytes().ljust(8, b"\0") + packed(np.diff(x))


def unpacked_rising(data: bytes, n: int) -> np.ndarray:
    """The n numbers that packed_rising had."""
    if not n:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = np.frombuffer(data, np.uint64, 1)[0]
    out[1:] = unpacked(data[8:])
    return np.cumsum(out, dtype=np.uint64)


def column(batch: pa.RecordBatch, name: str, dtype: type | np.dtype) -> np.ndarray:
    """All of a binary column's values, joined, as numbers."""
    values = batch.column(name).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


def gathered(batches: Iterator[pa.RecordBatch], **columns: type) -> tuple[np.ndarray, ...]:
    """The named binary columns of all batches, each joined to one array."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in columns}
    for batch in batches:
        for k, dtype in columns.items():
            parts[k].append(column(batch, k, dtype).copy())
    release_memory()
    return tuple(np.concatenate(v) if v else np.zeros(0, columns[k]) for k, v in parts.items())


def split(bucket: np.ndarray, n: int, *values: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(bucket, values of that bucket in their order) for each bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    sorted_values = [v[order] for v in values]
    at = 0
    for b in range(n):
        if ends[b] > at:
            yield b, tuple(v[at : ends[b]] for v in sorted_values)
            at = int(ends[b])


def rows(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Even bucket of each 64-bit hash, by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[k] .. starts[k] + lengths[k] - 1 for each k, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before, lengths) + np.repeat(starts, lengths)


def row_key(df: DataFrame) -> Column:
    """A 128-bit name of a row by all its columns: rows of one name are taken for repeated rows."""
    own = [F.col(f"`{c}`") for c in df.columns]
    nulls = F.concat_ws("", *(F.when(c.isNull(), "1").otherwise("0") for c in own))
    return F.struct(F.xxhash64(*own, nulls).alias("a"), F.xxhash64(F.lit(1), nulls, *own).alias("b"))


def by_key(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of docs with row_keys (columns a and b). Up to KEYS_AT_ONCE keys go to every executor and the texts stay where they are; more are joined by a shuffle."""
    few = keys.limit(KEYS_AT_ONCE + 1).count() <= KEYS_AT_ONCE
    name = "row_key"
    while name in docs.columns:
        name += "_"
    keyed, wanted = docs.select("*", row_key(docs).alias(name)), keys.select(F.struct("a", "b").alias(name))
    return keyed.join(F.broadcast(wanted) if few else wanted, name, how).select(*(f"`{c}`" for c in docs.columns))


def only(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose row_key is in `dropped` (columns a and b)."""
    return by_key(docs, checkpointed(dropped.select("a", "b").distinct()), "left_anti")
