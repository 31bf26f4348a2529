"""The crawl database: merging states, choosing what to fetch, and pacing domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trawlnet.schema import ACTIVE, MAX_INTERVAL_MS, MIN_DOMAIN_SCORE, MOVING_AVERAGE, QUEUE_SIZE, TARGET_INTERVAL_MS


def merge(updates: DataFrame) -> DataFrame:
    """One state for each url of updates (url, pld, status, previous_status, status_time, score, next_fetch_time, seq).

    Unfetched states of a URL add up: scores are summed, the latest status time and the earliest fetch time hold. Any other state wins
    over unfetched ones, of several the latest, on a tie the first by seq.
    """
    done = F.col("status") != "UNFETCHED"
    latest = F.max(F.when(done, F.struct("status_time", (-F.col("seq")).alias("first"), "status", "previous_status", "score", "next_fetch_time")))
    return (
        updates.groupBy("url")
        .agg(F.first("pld").alias("pld"), latest.alias("d"), F.max("status_time").alias("t"), F.sum("score").alias("s"), F.min("next_fetch_time").alias("n"))
        .select(
            "url", "pld", F.coalesce("d.status", F.lit("UNFETCHED")).alias("status"), F.col("d.previous_status").alias("previous_status"),
            *(F.when(F.col("d").isNotNull(), F.col(f"d.{name}")).otherwise(F.col(k)).alias(name) for name, k in (("status_time", "t"), ("score", "s"), ("next_fetch_time", "n"))),
        )
    )


def checked(updates: DataFrame) -> DataFrame:
    """updates, with an error at a state that can't be: fetched or failed at no time."""
    bad = (F.col("status") != "UNFETCHED") & (F.col("status_time") == 0)
    return updates.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("state without a time: "), F.col("url")))).otherwise(F.col("status")))


def checked_new(states: DataFrame) -> DataFrame:
    """states of URLs not met before, with an error at one that is said to be at work already."""
    return states.withColumn("status", F.when(F.col("status").isin(*ACTIVE), F.raise_error(F.concat(F.lit("new URL at work: "), F.col("url")))).otherwise(F.col("status")))


def without_archived(states: DataFrame, archived: DataFrame) -> DataFrame:
    """states whose url isn't among the archived ones."""
    return states.join(archived.select("url"), "url", "left_anti")


def fetch_queue(states: DataFrame, size: int = QUEUE_SIZE, min_score: float = 0.0, shard: Column | None = None, order: Column | None = None) -> DataFrame:
    """states with `rank`: of each shard (all together if none is named) the `size` unfetched URLs of the highest scores, none below min_score; of equals the first by `order` (url).

    A single queue is the top `size` of each task, then of those. With shards each shard is ranked in a task of its own.
    """
    by = F.col("url") if order is None else order
    ready = states.filter((F.col("status") == "UNFETCHED") & (F.col("score") >= min_score))
    if shard is None:
        ready = ready.orderBy(F.desc("score"), by).limit(size)
    window = W.partitionBy(F.lit(0) if shard is None else shard).orderBy(F.desc("score"), by)
    return ready.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= size)


def queued(states: DataFrame, chosen: DataFrame, now: int) -> DataFrame:
    """states, those of the chosen URLs marked QUEUED at `now`."""
    hit = states.join(chosen.select("url", F.lit(True).alias("__hit")), "url", "left")
    return hit.withColumns(
        {"previous_status": F.when(F.col("__hit"), F.col("status")).otherwise(F.col("previous_status")), "status": F.when(F.col("__hit"), F.lit("QUEUED")).otherwise(F.col("status")), "status_time": F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("status_time"))}
    ).select(*states.columns)


def evicted(states: DataFrame) -> DataFrame:
    """Queued states put back to the status they had, so that they can be chosen again."""
    return states.withColumns({"status": F.coalesce("previous_status", F.lit("UNFETCHED")), "previous_status": F.lit(None).cast("string")})


def moving_average(scores: DataFrame, n: int = MOVING_AVERAGE) -> DataFrame:
    """scores (pld, seq, score) with `average`: the mean of the domain's last n scores at each."""
    return scores.withColumn("average", F.avg("score").over(W.partitionBy("pld").orderBy("seq").rowsBetween(1 - n, 0)))


def latest_scores(scores: DataFrame) -> DataFrame:
    """(pld, score) the last score of each domain by seq, not below the least."""
    return scores.groupBy("pld").agg(F.greatest(F.lit(MIN_DOMAIN_SCORE), F.max_by("score", "seq")).alias("score"))


def check_interval(score: Column, average: Column) -> Column:
    """Milliseconds between a domain's turns: 200 at the average score, less at a higher one, within 1 and 1000; 1000 without a score."""
    wanted = F.floor(F.lit(float(TARGET_INTERVAL_MS)) * average / score + 0.5)
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(MAX_INTERVAL_MS), wanted)), F.lit(MAX_INTERVAL_MS)).cast("bigint")


def check_intervals(scores: DataFrame) -> DataFrame:
    """(pld, score, interval_ms) from latest domain scores (pld, score); the average is one row for all."""
    return scores.crossJoin(F.broadcast(scores.agg(F.avg("score").alias("average")))).select("pld", "score", check_interval(F.col("score"), F.col("average")).alias("interval_ms"))


def within_quota(candidates: DataFrame, intervals: DataFrame, round_ms: int) -> DataFrame:
    """Of each domain as many candidates as it has turns in a round, those of the highest scores first."""
    turns = F.ceil(F.lit(round_ms) / F.coalesce("interval_ms", F.lit(MAX_INTERVAL_MS)))
    place = F.row_number().over(W.partitionBy("pld").orderBy(F.desc("score"), "url"))
    return candidates.join(intervals.select("pld", "interval_ms"), "pld", "left").withColumn("__place", place).filter(F.col("__place") <= turns).select(*candidates.columns)


def status_counts(states: DataFrame) -> DataFrame:
    """(status, n)."""
    return states.groupBy("status").agg(F.count("*").alias("n"))
