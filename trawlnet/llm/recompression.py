"""Repeated passages by recompression: rounds name runs and pairs of symbols globally, and shared high-level symbols give repeats away.

Texts, each different one once, are spread over homes by hash; a text begins as its words, which get names like all symbols after them. A round first takes each run of one symbol that covers
`RUN_WORDS` words as one symbol, then each pair of a left and a right symbol: which symbols are left ones is a coin toss per symbol and
round, the same in all texts. Homes send the distinct runs and pairs they have to the owners of their names. An owner sees all homes' and
gives one name to equal ones; what is met at one place of the corpus only gets none and leaves the text, as it can't lie inside a passage that occurs twice.

What a round does at a place depends on the neighbouring symbols only, so two occurrences of a passage are cut alike but for at most one symbol a round at either end, or a
run that goes on beyond the end. `settings` sums that up: a passage of min_words words has `anchor_words` words of its inside in whole symbols after the
rounds, whatever surrounds it, unless it has a run, and runs are anchors themselves. Sequences of symbols that cover so many words and occur at several places
reveal where passages may be; there the windows of `min_words` words are named from the words themselves, which verifies the passages and finds their exact ends.

Before they have names, words are 39 bits of their hashes: that two different words are one symbol (1 in 10**11) would have to befall each word in which two passages differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blob, buckets, checkpointed, exchange, forget, packed, unpacked
from .passages import HOME_END, MIN_WORDS, RECORD_SPANS, REPLIES, TEXT, around, distinct_keys, homes_of, is_shared, key_rows, known_rows, of_home, owned, read_text, region_text, rows_of, shared_keys, spans_at, spread, text_row, with_replies
from .textkit import _BASE, _INVERSE, mix, powers, window_hashes

ROUNDS = 3
#: Words from which on a run is one symbol, and an anchor.
RUN_WORDS = 4
_RUN, _LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def settings(min_words: int) -> tuple[int, int]:
    """(rounds, anchor_words): the most rounds, up to ROUNDS, after which the inside of any passage without runs has a sequence of symbols over anchor_words words.

    At either end a round costs a symbol, of up to 2**k words in round k, and in one of them a run of fewer than RUN_WORDS words, or a symbol, and its neighbour. A sequence exceeds its words by less than a symbol.
    """
    for rounds in range(ROUNDS, 0, -1):
        lost = 2**rounds - 1 + max(RUN_WORDS - 1, 2 ** (rounds - 1)) + 2 ** (rounds - 1)
        width = min_words - 2 * lost - (2**rounds - 1)
        if width >= 2 ** (rounds - 1):
            return rounds, width
    raise ValueError("min_words is too small")


def cut(symbol: np.ndarray, start: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, starts and sizes in words after round k, which of them are new (runs or pairs), and start, end and symbol of the runs. Round -1 names the words."""
    n = len(symbol)
    if not n or k < 0:
        return symbol, start, size, np.full(n, k < 0), np.zeros((0, 3), np.uint64)
    next_to = start[:-1] + size[:-1] == start[1:]
    head = np.r_[True, (symbol[1:] != symbol[:-1]) | ~next_to]
    at = np.flatnonzero(head)
    length = np.diff(np.r_[at, n])
    last = at + length - 1
    covers = start[last] + size[last] - start[at]
    run = (length > 1) & (covers >= RUN_WORDS)
    found = np.stack([start[at[run]].astype(np.uint64), (start[at[run]] + covers[run]).astype(np.uint64), symbol[at[run]]], 1)
    inside = np.zeros(n + 1, np.int64)
    inside[at[run] + 1] += 1
    inside[at[run] + length[run]] -= 1
    keep = np.cumsum(inside[:n]) == 0
    key, sizes, new = symbol.copy(), size.copy(), np.zeros(n, bool)
    key[at[run]] = mix(symbol[at[run]] + _RUN * length[run].astype(np.uint64))
    sizes[at[run]], new[at[run]] = covers[run], True
    key, start, size, new = key[keep], start[keep], sizes[keep], new[keep]
    left = mix(key ^ np.uint64(k + 1)) >> np.uint64(63) == 1
    pair = np.flatnonzero(left[:-1] & ~left[1:] & (start[:-1] + size[:-1] == start[1:]))
    key[pair] = mix(key[pair] * _LEFT + key[pair + 1] * _RIGHT + np.uint64(k + 1))
    size = size.copy()
    size[pair] += size[pair + 1]
    new[pair] = True
    keep = np.ones(len(key), bool)
    keep[pair + 1] = False
    return key[keep], start[keep], size[keep], new[keep], found


def _names(k: int, n: int):
    """An owner's names, one for equal keys of all homes and 0 for those met once, sent back in the order of each home's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, homes, at, shared = owned(batches)
        name = np.where(shared, (np.cumsum(shared).astype(np.uint64) * np.uint64(n) + np.uint64(max(owner, 0))) * np.uint64(ROUNDS + 1) + np.uint64(k + 1), np.uint64(0))
        lo = 0
        for home, size in homes:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([home], pa.int32()), "source": pa.array([owner], pa.int32()), "names": [packed(name[at[lo : lo + size]])]})
            lo += size

    return run, REPLIES


def _new_keys(k: int):
    """The runs and pairs of a home in round k."""

    def keys(row: dict) -> np.ndarray:
        key, _, _, new, _ = cut(*read_text(row), k)
        return key[new]

    return keys


def _renamed(k: int, n: int):
    """A home's text of the next round: what got no name is left out. Words stay in their places, without a name as 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, replies = of_home(batches)
        if text is None:
            return
        key, start, size, new, found = cut(*read_text(text), k)
        mine = list(distinct_keys(key[new], n))
        if mine:
            keys, names = np.concatenate([x for _, x, _ in mine]), np.concatenate([unpacked(replies[b]) for b, _, _ in mine])
            order = np.argsort(keys)
            key[new] = names[order][np.searchsorted(keys[order], key[new])]
        if k < 0:
            yield text_row(text["bucket"], key, texts=text["texts"])
            return
        keep = key > 0
        yield text_row(text["bucket"], key[keep], start[keep], size[keep], text["runs"] + blob(found))

    return run, TEXT


def anchors(symbol: np.ndarray, start: np.ndarray, size: np.ndarray, found: np.ndarray, anchor_words: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first word and end of each sequence of neighbouring symbols that takes anchor_words words to cover, and of the runs, which the last array tells apart: a passage may hold a part of one. A run that repeats itself counts twice."""
    n = len(symbol)
    a, b, key = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n:
        ends = start + size
        part = np.cumsum(np.r_[0, start[1:] != ends[:-1]])
        last = np.searchsorted(ends, start + anchor_words)
        ok = last < n
        ok[ok] = part[last[ok]] == part[ok]
        first, last = np.flatnonzero(ok), last[ok]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbol * powers(_BASE, n), out=sums[1:])
        key = mix((sums[last + 1] - sums[first]) * powers(_INVERSE, n + 1)[first] + (last + 1 - first).astype(np.uint64))
        a, b = start[first], ends[last]
    head, end, name = found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), mix(found[:, 2] + _RUN)
    again = end - head >= anchor_words  # a passage may overlap itself by nearly all of one run, whose ends its surroundings have cut off
    of_run = np.r_[np.zeros(len(key), bool), np.ones(len(name) + int(again.sum()), bool)]
    return np.r_[key, name, name[again]], np.r_[a, head, head[again] + 1], np.r_[b, end, end[again]], of_run


def _regions(row_anchors: Callable[[dict], tuple[np.ndarray, ...]], min_words: int, n: int):
    """A home's regions around its anchors that are met at several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, replies = of_home(batches)
        if text is None:
            return
        key, a, b, of_run = row_anchors(text)
        ok = is_shared(key, replies, n)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([text["bucket"]], pa.int32()), "source": pa.array([0], pa.int32()), "names": [blob(around(a[ok], b[ok], min_words, of_run[ok]))]})

    return run, REPLIES


def windows(symbols: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the windows of min_words words in a home's region text. One with a word met once (0), or over the end of a region, is in no passage."""
    gaps = np.r_[0, np.cumsum((symbols == 0) | (symbols >= HOME_END))]
    place = np.flatnonzero(gaps[min_words:] == gaps[: max(0, len(gaps) - min_words)])
    return place, window_hashes(symbols, min_words)[place]


def _verified(min_words: int, n: int):
    """Spans of a home's records where windows begin that are met at several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, replies = of_home(batches)
        if text is None:
            return
        place, key = windows(unpacked(text["symbols"]), min_words)
        yield spans_at(place[is_shared(key, replies, n)], text["aux"], min_words)

    return run, RECORD_SPANS


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word) of the maximal parts of docs (doc_id, text) made of passages of min_words words that occur twice or more.

    By `settings` none is missed. Occurrences may be in one text or several and may overlap. Equal texts are occurrences of each other. Null and empty texts have none; rows of
    null doc_id aren't searched; a row repeated whole counts as an occurrence, reported once; an empty table has none; other columns are ignored.
    """
    n = buckets(docs.sparkSession)
    rounds, anchor_words = settings(min_words)
    rows = rows_of(docs)
    first = homes_of(rows, min_words)
    known = known_rows(rows, first)
    words = text = None
    for k in range(-1, rounds):
        before = first if k < 0 else text
        replies = exchange(before.mapInArrow(*key_rows(_new_keys(k), n))).mapInArrow(*_names(k, n))
        text = checkpointed(with_replies(before, replies).mapInArrow(*_renamed(k, n)))
        if k < 0:
            words = text
        if k != 0:
            forget(before)

    def row_anchors(row: dict) -> tuple[np.ndarray, ...]:
        return anchors(*read_text(row), np.frombuffer(row["runs"], np.uint64).reshape(-1, 3), anchor_words, min_words)

    found = with_replies(text, shared_keys(text, lambda row: row_anchors(row)[0], n)).mapInArrow(*_regions(row_anchors, min_words, n))
    parts = region_text(words, found, lambda row, replies: np.frombuffer(replies[0], np.int64).reshape(-1, 2) if replies else np.zeros((0, 2), np.int64), min_words)
    forget(words)
    forget(text)
    met = shared_keys(parts, lambda row: windows(unpacked(row["symbols"]), min_words)[1], n)
    spans = checkpointed(with_replies(parts, met).mapInArrow(*_verified(min_words, n)))
    return spread(spans, known, min_words)
