"""Training-data pipeline: repetition rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir); docs is what the stage before it kept, and its result is written as Parquet and
read again for the next. All but the last return the columns of documents, whatever others there are.

Stages judge rows, not doc_ids: rows of null doc_id and several texts under one doc_id are treated like any others. Null, empty and blank texts pass the first four stages as they
are and have no tokens to pack. Rows repeated whole go together, but for near_duplicates, which leaves one. An empty table stays empty and gives no bins.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from trawlnet.llm import decontaminate, jaccard_join, packing, pii, repetition
from trawlnet.llm.common import ensure_checkpoint_dir, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; the others go. See repetition.kept."""
    return repetition.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard pairs: that of the least doc_id, null ones after all others. See jaccard_join.one_per_group."""
    return jaccard_join.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark, exactly or by proximity. See decontaminate.clean."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data and secrets replaced by the kind in brackets. See pii.redacted."""
    return pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents' pieces: (bin_id, doc_id, piece, start_token, n_tokens). See packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Near duplicates, boosted trees and packing aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; what a stage kept is written under the shared folder and removed when the next but one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:
                remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
