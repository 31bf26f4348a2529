"""Indexes of a crawl archive: the sorted list of index segments, and the index lines within segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SEGMENT = r"^(.+?) +(\d+)\t(.+?)\t(\d+)\t(\d+)\t(\d+)$"
_LINE = r"^(.+?) +(\d+) +(\{.*\})$"
_FIELDS = "url string, status string, mime string, filename string, length string, offset string"


def segments(lines: DataFrame) -> DataFrame:
    """(key, timestamp, index_file, seg_offset, seg_length, seg_id) of lines (column value); an empty line is left out, another line that doesn't fit is an error."""
    part = lambda k: F.regexp_extract("value", _SEGMENT, k)
    fits = F.when(F.col("value").rlike(_SEGMENT), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a line of a segment index: "), F.col("value"))))
    return lines.filter("trim(value) <> ''").select(fits.alias("key"), part(2).alias("timestamp"), part(3).alias("index_file"), part(4).cast("bigint").alias("seg_offset"), part(5).cast("bigint").alias("seg_length"), part(6).cast("int").alias("seg_id"))


def cdx(lines: DataFrame) -> DataFrame:
    """(key, timestamp, url, status, mime, filename, offset, length) of index lines (column value); lines that don't fit are left out."""
    fields = F.from_json(F.regexp_extract("value", _LINE, 3), _FIELDS)
    return (
        lines.filter(F.col("value").rlike(_LINE))
        .select(F.regexp_extract("value", _LINE, 1).alias("key"), F.regexp_extract("value", _LINE, 2).cast("bigint").alias("timestamp"), fields.alias("f"))
        .select("key", "timestamp", "f.url", F.col("f.status").try_cast("int").alias("status"), "f.mime", "f.filename", F.col("f.offset").try_cast("bigint").alias("offset"), F.col("f.length").try_cast("bigint").alias("length"))
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return segments(spark.read.text(path))


def read_cdx(spark: SparkSession, path: str) -> DataFrame:
    return cdx(spark.read.text(path))


def save(index: DataFrame, path: str) -> None:
    """Keep an index as Parquet, in order of its key, so that lookups skip row groups."""
    index.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)
