"""When a crawl ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: From the round's number, the seconds since the start and the states, whether to stop.
Terminator = Callable[[int, float, DataFrame], bool]


def after_seconds(seconds: float) -> Terminator:
    return lambda r, elapsed, states: elapsed >= seconds


def after_rounds(n: int) -> Terminator:
    return lambda r, elapsed, states: r >= n


def after_pages(n: int) -> Terminator:
    """Stop once n pages were fetched."""
    return lambda r, elapsed, states: states.filter("status = 'FETCHED'").limit(n).count() >= n


def nothing_left(queue: DataFrame) -> bool:
    return queue.isEmpty()
