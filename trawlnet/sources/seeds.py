"""Seed URLs from text files, from lists or from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlnet.schema import DEFAULT_SCORE, RAW_URL


def of_lines(lines: DataFrame, score: float = DEFAULT_SCORE) -> DataFrame:
    """(url, score) of the lines (column value) that are neither empty nor comments."""
    return lines.select(F.trim("value").alias("url")).filter("url <> '' and not startswith(url, '#')").withColumn("score", F.lit(float(score)))


def read(spark: SparkSession, path: str, score: float = DEFAULT_SCORE) -> DataFrame:
    return of_lines(spark.read.text(path), score)


def read_stream(spark: SparkSession, folder: str, score: float = DEFAULT_SCORE, files_per_batch: int = 1) -> DataFrame:
    """The same of the files that appear in a folder."""
    return of_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder), score)


def of_urls(spark: SparkSession, urls: list[str] | list[tuple[str, float]], score: float = DEFAULT_SCORE) -> DataFrame:
    return spark.createDataFrame([u if isinstance(u, tuple) else (u, float(score)) for u in urls], RAW_URL)
