"""Stateful processors for crawls that run as streams: per domain, per origin, per queue shard.

Spark says nothing about the order of rows within a batch, so each processor sorts its rows by (status_time, seq) first. All of them need the
RocksDB state store (`use_state_store`). Their rows are those of the batch operators, and the final states are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trawlnet.functions.http import HOUR_MS, LIFETIMES_MS, OTHER_LIFETIME_MS
from trawlnet.schema import MAX_IN_FLIGHT, MOVING_AVERAGE, QUEUE_SIZE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _sorted(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame | None:
    parts = [r for r in rows if len(r)]
    return pd.concat(parts).sort_values(list(by), kind="stable") if parts else None


class MovingAverage(StatefulProcessor):
    """The mean of a domain's last n scores, at every score."""

    SCHEMA = "pld string, seq bigint, score double, average double"

    def __init__(self, n: int = MOVING_AVERAGE):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _sorted(rows, "seq")
        if batch is None:
            return
        held = [r[0] for r in self.last.get()] if self.last.exists() else []
        out = []
        for seq, score in zip(batch["seq"], batch["score"]):
            held = [*held, float(score)][-self.n :]
            out.append((key[0], seq, score, sum(held) / len(held)))
        self.last.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["pld", "seq", "score", "average"])

    def close(self) -> None:
        pass


class Politeness(StatefulProcessor):
    """Passes a request or skips it until its origin's next fetch time."""

    SCHEMA = "url string, origin string, now bigint, seq bigint, passed boolean, next_fetch_time bigint"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _sorted(rows, "now", "seq")
        if batch is None:
            return
        due = self.due.get()[0] if self.due.exists() else None
        out = []
        for url, now, seq, delay in zip(batch["url"], batch["now"], batch["seq"], batch["crawl_delay_ms"]):
            passed = due is None or now >= due
            out.append((url, key[0], now, seq, passed, None if passed else due))
            if passed:
                due = int(now + delay)
        self.due.update((due,))
        found = pd.DataFrame(out, columns=["url", "origin", "now", "seq", "passed", "next_fetch_time"])
        found["next_fetch_time"] = found["next_fetch_time"].astype("Int64")
        yield found

    def close(self) -> None:
        pass


class RobotsCache(StatefulProcessor):
    """Lets a request through to the fetch of its origin's rules only if none are held, on their way, or they have expired.

    Rows with a `code` are answers: their rules hold as long as robots.rules_of says of that status, from when they came. One that never comes is asked for again after `patience_ms`.
    """

    SCHEMA = "origin string, url string, now bigint, fetch_rules boolean"

    def __init__(self, patience_ms: int = 12 * HOUR_MS):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.expires = handle.getValueState("expires", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _sorted(rows, "now", "seq")
        if batch is None:
            return
        at = self.expires.get()[0] if self.expires.exists() else None
        out = []
        codes = batch["code"] if "code" in batch else [None] * len(batch)
        for url, now, code in zip(batch["url"], batch["now"], codes):
            if code is not None and not pd.isna(code):
                at = int(now) + LIFETIMES_MS.get(int(code), OTHER_LIFETIME_MS)
                continue
            fresh = at is None or now >= at
            if fresh:
                at = int(now) + self.patience
            out.append((key[0], url, now, fresh))
        if at is not None:
            self.expires.update((at,))
        yield pd.DataFrame(out, columns=["origin", "url", "now", "fetch_rules"])

    def close(self) -> None:
        pass


class CrawlDb(StatefulProcessor):
    """A domain's states by URL: merges updates as crawldb.merge does and gives each changed state."""

    SCHEMA = "url string, pld string, status string, previous_status string, status_time bigint, score double, next_fetch_time bigint"
    _FIELDS = ("status", "previous_status", "status_time", "score", "next_fetch_time")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "url string", "status string, previous_status string, status_time bigint, score double, next_fetch_time bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _sorted(rows, "status_time", "seq")
        if batch is None:
            return
        changed: dict[str, tuple] = {}
        for url, *new in batch[["url", *self._FIELDS]].itertuples(index=False):
            new = tuple(None if pd.isna(v) else v for v in new)
            old = changed.get(url) or (tuple(self.states.getValue((url,))) if self.states.containsKey((url,)) else None)
            changed[url] = new if old is None else merged(old, new)
        for url, state in changed.items():
            self.states.updateValue((url,), state)
        yield pd.DataFrame([(url, key[0], *s) for url, s in changed.items()], columns=["url", "pld", *self._FIELDS])

    def close(self) -> None:
        pass


def merged(first: tuple, second: tuple) -> tuple:
    """Of two states (status, previous_status, status_time, score, next_fetch_time) what holds: see crawldb.merge."""
    if first[0] == "UNFETCHED" == second[0]:
        return first[0], first[1], max(first[2], second[2]), first[3] + second[3], min(first[4], second[4])
    if first[0] == "UNFETCHED":
        return second
    if second[0] == "UNFETCHED":
        return first
    return second if second[2] > first[2] else first


class FetchQueue(StatefulProcessor):
    """A shard's queue of the best candidates: at each batch it takes candidates and ends of fetches, evicts the lowest beyond its size and
    gives those that may be fetched now.

    Rows in: kind (candidate, done), url, score, seq. Rows out: kind (fetch, evicted), url, score.
    """

    SCHEMA = "shard bigint, kind string, url string, score double"

    def __init__(self, size: int = QUEUE_SIZE, most_in_flight: int = MAX_IN_FLIGHT, min_score: float = 0.0):
        self.size, self.most, self.min_score = size, most_in_flight, min_score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "url string, score double")
        self.flying = handle.getValueState("in_flight", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        batch = _sorted(rows, "seq")
        if batch is None:
            return
        held = [tuple(r) for r in self.queue.get()] if self.queue.exists() else []
        n = self.flying.get()[0] if self.flying.exists() else 0
        n = max(0, n - int((batch["kind"] == "done").sum()))
        new = batch[(batch["kind"] == "candidate") & (batch["score"] >= self.min_score)]
        best: dict[str, float] = {}
        for url, score in [*held, *zip(new["url"], new["score"].astype(float))]:  # a URL offered again stays once, with its best score
            best[url] = max(score, best.get(url, score))
        held = sorted(best.items(), key=lambda x: -x[1])
        out = [("evicted", *x) for x in held[self.size :]]
        held = held[: self.size]
        free = max(0, self.most - n)
        out += [("fetch", *x) for x in held[:free]]
        n += len(held[:free])
        held = held[free:]
        self.queue.put(held) if held else self.queue.clear()
        self.flying.update((n,))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["shard", "kind", "url", "score"])

    def close(self) -> None:
        pass


def processed(rows: DataFrame, key: str, processor: StatefulProcessor, mode: str = "Append") -> DataFrame:
    """rows, grouped by key, through a processor; its SCHEMA says what comes out."""
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode=mode, timeMode="None")


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool = True):  # noqa: ANN201
    """Start a stream whose batches `handle` gets; with available_now it ends when what is there has been read."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
