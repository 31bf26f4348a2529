"""Shared frame of the two searches for long passages that occur more than once.

Texts are spread over *homes* by a 64-bit hash of the text, their name as *records*; equal texts are one record. A search says which anchors (short runs of
words) a home has. Anchors met at one place of the corpus only are dropped, and the *regions* around the others are where passages may be. What a search finds per
record is spread to all rows of the record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH, blob, bucket_of, buckets, checkpointed, exchange, joined, packed, packed_rising, ranges, split, unpacked, unpacked_rising
from .textkit import chunks, mix, words

MIN_WORDS = 50
SPANS = "doc_id bigint, start_word int, end_word int"
#: A home's text: its symbols, where each begins and its words, runs found so far, and (place, record, words) of its texts.
TEXT = "bucket int, symbols binary, starts binary, sizes binary, runs binary, texts binary"
REPLIES = "bucket int, source int, names binary"
REGIONS = "bucket int, symbols binary, aux binary"
#: Symbols from here on end the text of a home.
HOME_END = np.uint64(1 << 40)
#: Low bits of a word's hash that aren't kept.
_DROPPED = np.uint64(25)


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, record, text) of the rows that have a doc_id."""
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("record"), F.col("text").cast("string").alias("text"))


def spread_texts(min_words: int, n: int):
    """Words of the texts of min_words words or more, in buckets of their hashes; a task sends equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        met, size = np.zeros(0, np.int64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            record, count, symbols = (np.concatenate(x) for x in zip(*held))
            home = bucket_of(mix(record.view(np.uint64)), n)
            texts = {b: x for b, x in split(home, n, record, count)}
            for b, (s,) in split(np.repeat(home, count), n, symbols):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "records": [blob(texts[b][0])], "counts": [packed(texts[b][1])], "words": [packed(s)]})

        for piece in chunks(batches):
            w = words(piece.column("text"))
            record, counts = piece.column("record").to_numpy(), w.counts
            _, first = np.unique(record, return_index=True)
            first = np.sort(first[(counts[first] >= min_words) & ~np.isin(record[first], met)])
            met = np.union1d(met, record[first])
            own = np.maximum(w.hashes[ranges(w.bounds[first], counts[first])] >> _DROPPED, np.uint64(1))
            held.append((record[first], counts[first], own))
            size += len(own)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run, "bucket int, records binary, counts binary, words binary"


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A home's texts, each record once, a place apart: symbols and the texts' (place, record, words)."""
    home, met, at = -1, set(), 0
    parts: list[np.ndarray] = []
    table: list[tuple[int, int, int]] = []
    for batch in batches:
        for row in batch.to_pylist():
            home = row["bucket"]
            records, counts, own = np.frombuffer(row["records"], np.int64), unpacked(row["counts"]).astype(np.int64), unpacked(row["words"])
            begin = np.cumsum(counts) - counts
            for r, a, c in zip(records.tolist(), begin.tolist(), counts.tolist()):
                if r not in met:
                    met.add(r)
                    table.append((at, r, c))
                    parts.append(own[a : a + c])
                    at += c + 1
    if home >= 0:
        yield text_row(home, np.concatenate(parts), texts=blob(np.array(table, np.int64)))


def text_row(home: int, symbols: np.ndarray, start: np.ndarray | None = None, size: np.ndarray | None = None, found: bytes = b"", texts: bytes = b"") -> pa.RecordBatch:
    """A row of TEXT; of the symbols' starts only those are written that aren't the end of the one before."""
    starts = sizes = b""
    if start is not None:
        at = np.flatnonzero(np.r_[True, start[1:] != (start + size)[:-1]][: len(start)])
        starts, sizes = len(at).to_bytes(8, "little") + blob(np.r_[at, start[at]].astype(np.int64)), packed(size)
    return pa.RecordBatch.from_pydict({"bucket": pa.array([home], pa.int32()), "symbols": [packed(symbols)], "starts": [starts], "sizes": [sizes], "runs": [found], "texts": [texts]})


def read_text(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a home, where each begins and its words; at first, when they are words, the texts tell that. Symbols without a name are left out."""
    symbols = unpacked(row["symbols"])
    if row["texts"]:
        table = np.frombuffer(row["texts"], np.int64).reshape(-1, 3)
        keep = symbols > 0
        return symbols[keep], ranges(table[:, 0], table[:, 2])[keep], np.ones(int(keep.sum()), np.int64)
    size = unpacked(row["sizes"]).astype(np.int64)
    n = int.from_bytes(row["starts"][:8], "little")
    at, first = np.frombuffer(row["starts"], np.int64, offset=8).reshape(2, n)
    before = np.cumsum(size) - size
    return symbols, before + np.repeat(first - before[at], np.diff(np.r_[at, len(size)])), size


def with_replies(texts: DataFrame, replies: DataFrame, n: int | None = None) -> DataFrame:
    """Texts and what came back for them, those of a home in one partition."""
    return exchange(texts.unionByName(replies, allowMissingColumns=True), n=n)


def merged(owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals, sorted by owner and low, joined where they touch or overlap."""
    if not len(owner):
        return owner, low, high
    group = np.cumsum(np.r_[0, owner[1:] != owner[:-1]])
    shift = group * (int(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    head = np.r_[True, (low + shift)[1:] > reach[:-1]]
    starts = np.flatnonzero(head)
    ends = np.r_[starts[1:], len(owner)] - 1
    return owner[starts], low[starts], (reach - shift)[ends]


def distinct_keys(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Owner, keys (rising) and whether a home has each several times."""
    names, count = np.unique(key, return_counts=True)
    for b, (x, c) in split(bucket_of(mix(names), n), n, names, count):
        yield b, x, c > 1


def key_rows(keys_of: Callable[[dict], np.ndarray], n: int):
    """A home's distinct keys, for their owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for b, x, several in distinct_keys(keys_of(row), n):
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "home": pa.array([row["bucket"]], pa.int32()), "keys": [packed_rising(x)], "several": [blob(several)]})

    return joined(run), "bucket int, home int, keys binary, several binary"


def owned(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """An owner, the homes that sent keys and how many, for each of their keys its number among the distinct ones, and whether each of those is met at several places."""
    owner, parts = -1, []
    for batch in batches:
        for row in batch.to_pylist():
            owner, several = row["bucket"], np.frombuffer(row["several"], bool)
            parts.append((row["home"], unpacked_rising(row["keys"], len(several)), several))
    if owner < 0:
        return owner, [], np.zeros(0, np.int64), np.zeros(0, bool)
    _, at, count = np.unique(np.concatenate([x for _, x, _ in parts]), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[at[np.concatenate([s for _, _, s in parts])]] = True
    return owner, [(home, len(x)) for home, x, _ in parts], at, shared


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each home, for its keys in its order, whether they are met at several places."""
    owner, homes, at, shared = owned(batches)
    lo = 0
    for home, n in homes:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([home], pa.int32()), "source": pa.array([owner], pa.int32()), "names": [blob(np.packbits(shared[at[lo : lo + n]]))]})
        lo += n


def shared_keys(homes: DataFrame, keys_of: Callable[[dict], np.ndarray], n: int) -> DataFrame:
    """What the owners answer homes about their keys. A key goes from a home to its owner once, however often the home has it."""
    return exchange(homes.mapInArrow(*key_rows(keys_of, n)), n=n).mapInArrow(joined(_answers), REPLIES)


def is_shared(key: np.ndarray, replies: dict[int, bytes], n: int) -> np.ndarray:
    """Of a home's keys those that its answers say are met at several places."""
    mine = list(distinct_keys(key, n))
    if not mine:
        return np.zeros(0, bool)
    names = np.concatenate([x for _, x, _ in mine])
    bits = np.concatenate([np.unpackbits(np.frombuffer(replies[b], np.uint8), count=len(x)) for b, x, _ in mine]) > 0
    order = np.argsort(names)
    return bits[order][np.searchsorted(names[order], key)]


def of_home(batches: Iterator[pa.RecordBatch]) -> tuple[dict | None, dict[int, bytes]]:
    """A home's text and the answers to it."""
    text, replies = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["source"] is None:
                text = row
            else:
                replies[row["source"]] = row["names"]
    return text, replies


def around(start: np.ndarray, end: np.ndarray, min_words: int, partly: np.ndarray | None = None) -> np.ndarray:
    """(low, high) where passages of min_words words may be that hold an anchor, or may overlap one that is no shorter or that counts partly; merged."""
    whole = end - start < min_words
    if partly is not None:
        whole &= ~partly
    low, high = np.where(whole, end, start) - min_words, np.where(whole, start, end) + min_words
    order = np.argsort(low, kind="stable")
    _, low, high = merged(np.zeros(len(low), np.int64), np.maximum(low[order], 0), high[order])
    return np.stack([low, high], 1)


def region_text(homes: DataFrame, replies: DataFrame, regions_of: Callable[[dict, dict[int, bytes]], np.ndarray], min_words: int, n: int | None = None) -> DataFrame:
    """Of each home its regions of min_words words or more joined to one text, 0 between them and HOME_END + home at the end; aux has (place, record, first word, words) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, answers = of_home(batches)
        if text is None:
            return
        found = regions_of(text, answers)
        low, high = found[:, 0], found[:, 1]
        table, own = np.frombuffer(text["texts"], np.int64).reshape(-1, 3), unpacked(text["symbols"])
        # a region that reaches over the end of a text is one in each
        first, last = np.searchsorted(table[:, 0], low, "right") - 1, np.searchsorted(table[:, 0], high, "left") - 1
        which, of = np.repeat(np.arange(len(low)), last - first + 1), ranges(first, last - first + 1)
        low, high = np.maximum(low[which], table[of, 0]), np.minimum(high[which], table[of, 0] + table[of, 2])
        ok = high - low >= min_words
        low, of, size = low[ok], of[ok], (high - low)[ok]
        if not len(low):
            return
        at = np.cumsum(size + 1) - size - 1
        symbols = np.zeros(int(at[-1] + size[-1]) + 1, np.uint64)
        symbols[ranges(at, size)] = own[ranges(low - of, size)]
        symbols[-1] = HOME_END + np.uint64(text["bucket"])
        aux = np.stack([at, table[of, 1], low - table[of, 0], size], 1)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([text["bucket"]], pa.int32()), "symbols": [packed(symbols)], "aux": [blob(aux)]})

    return checkpointed(with_replies(homes, replies, n).mapInArrow(run, REGIONS))


def spans_at(places: np.ndarray, aux: bytes, min_words: int) -> pa.RecordBatch:
    """(record, start_word, end_word) of a home from the places of its region text, rising, where passages begin that occur twice. A home has all of a record."""
    table = np.frombuffer(aux, np.int64).reshape(-1, 4)
    at = np.searchsorted(table[:, 0], places, "right") - 1
    record, word = table[at, 1], table[at, 2] + places - table[at, 0]
    order = np.lexsort((word, record))
    r, a, b = merged(record[order], word[order], word[order] + min_words)
    return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["record", "start_word", "end_word"])


RECORD_SPANS = "record bigint, start_word int, end_word int"


def spread(spans: DataFrame, known: DataFrame, min_words: int) -> DataFrame:
    """SPANS of all rows from those of the records. Texts of min_words words that occur twice are spans as a whole."""
    copied = known.groupBy("record").agg(F.count("*").alias("n"), F.max("n_words").alias("end_word"))
    whole = known.select("doc_id", "record").join(copied.filter(f"n > 1 and end_word >= {min_words}"), "record").select("doc_id", F.lit(0).alias("start_word"), "end_word")
    single = spans.join(copied.filter("n = 1"), "record", "left_semi").join(known, "record").select("doc_id", "start_word", "end_word")
    return single.unionByName(whole).distinct()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in batch.column("texts").to_pylist():
            table = np.frombuffer(texts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, 1]), pa.array(table[:, 2], pa.int32())], ["record", "n_words"])


def homes_of(rows: DataFrame, min_words: int, n: int | None = None) -> DataFrame:
    """The homes of all texts of min_words words or more, kept in the shared folder."""
    n = n or buckets(rows.sparkSession)
    return checkpointed(exchange(rows.select("record", "text").mapInArrow(*spread_texts(min_words, n)), n=n).mapInArrow(_homes, TEXT))


def known_rows(rows: DataFrame, homes: DataFrame) -> DataFrame:
    """(doc_id, record, n_words) of the rows whose texts are in homes."""
    return checkpointed(rows.select("doc_id", "record").join(homes.select("texts").mapInArrow(_sizes, "record bigint, n_words int"), "record"))
