"""Benchmark decontamination with a distributed positional inverted index of the training tokens.

The index is partitioned by document: a row of it is a shard of documents with, per term, the sorted positions of its
occurrences. It holds every token of the corpus, is written once to the shared folder, and serves any test set. Every test phrase is looked up in
every shard by intersecting the position lists of its terms, each shifted by the term's offset in the phrase, beginning with the term that is
rarest in the whole corpus. Only matches are shuffled.

Words are folded: ASCII letters in lower case, other ASCII characters than letters and digits are white space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blob, checkpointed, column, only, packed, packed_rising, ranges, row_key, runs, unpacked, unpacked_rising
from .textkit import chunks, folding_table, words

PHRASE = 8
NEAR_PHRASE = 13
SLOP = 2
#: Test words that a search takes to every shard at once; a larger test set is a query set of several blocks.
TEST_WORDS_AT_ONCE = 4_000_000
MATCHES = "doc_id bigint, item_id bigint, kind string, windows bigint, first_word bigint, last_word bigint"
_FOUND = "a bigint, b bigint, " + MATCHES
_SHARD_BYTES = 2 << 20
_POS = np.uint64(32)


class Phrases:
    """All windows of `length` words of the test items (a shorter item is one phrase): by phrase length the phrases' numbers and terms; by phrase its item and length."""

    def __init__(self, texts: list[str | None], length: int, least: int = 1):
        w = words(pa.array(texts, pa.string()), folding_table())
        counts = w.counts
        long = np.flatnonzero(counts >= max(least, length))
        n = counts[long] - length + 1
        short = np.flatnonzero((counts >= max(least, 1)) & (counts < length))
        self.item = np.r_[np.repeat(long, n), short].astype(np.int64)
        first = np.r_[ranges(w.bounds[long], n), w.bounds[short]].astype(np.int64)
        self.length = np.r_[np.full(int(n.sum()), length), counts[short]].astype(np.int64)
        self.by_length = []
        for size in np.unique(self.length):
            which = np.flatnonzero(self.length == size)
            self.by_length.append((which, w.hashes[first[which, None] + np.arange(size)]))

    def plan(self, vocabulary: np.ndarray, frequency: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per phrase length: phrase numbers, terms and offsets, each row from the rarest term to the commonest."""
        out = []
        for which, hashes in self.by_length:
            terms = np.searchsorted(vocabulary, hashes)
            offsets = np.argsort(frequency[terms], axis=1, kind="stable")
            out.append((which, np.take_along_axis(terms, offsets, 1), offsets))
        return out


def index(docs: DataFrame, gap: int = NEAR_PHRASE + 4 * SLOP + PHRASE) -> DataFrame:
    """Shards of docs (doc_id, text): the terms (hashes, rising), how often each occurs, and its places; documents begin at `bounds`, `gap` places or more apart."""
    key = row_key(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, size=_SHARD_BYTES):
            w = words(piece.column("text"), folding_table())
            ids = piece.column("doc_id")
            order = np.argsort(w.hashes, kind="stable")
            terms = w.hashes[order]
            starts, lengths = runs(terms)
            place = np.arange(len(terms)) + w.owner * gap
            yield pa.RecordBatch.from_pydict(
                {
                    "docs": [blob(ids.fill_null(0).to_numpy())],
                    "nulls": [blob(ids.is_null().to_numpy(zero_copy_only=False))],
                    "keys": [blob(np.stack([piece.column(c).to_numpy() for c in ("a", "b")], 1))],
                    "bounds": [packed_rising(w.bounds[:-1] + np.arange(len(ids)) * gap)],
                    "terms": [packed_rising(terms[starts])],
                    "counts": [packed(lengths)],
                    "places": [packed(place[order])],
                }
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key["a"].alias("a"), key["b"].alias("b"))
    return checkpointed(rows.mapInArrow(run, "docs binary, nulls binary, keys binary, bounds binary, terms binary, counts binary, places binary"))


def _shard_terms(row: dict) -> tuple[np.ndarray, np.ndarray]:
    counts = unpacked(row["counts"]).astype(np.int64)
    return unpacked_rising(row["terms"], len(counts)), counts


def _known(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the vocabulary and in terms (both rising) of what they share."""
    if not len(vocabulary) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    both = np.flatnonzero(terms[at] == vocabulary)
    return both, at[both]


def _frequency(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each term of the vocabulary in the whole corpus."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = _shard_terms(row)
                term, at = _known(terms, sent.value)
                total[term] += counts[at]
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "n": pa.array(total[term])})

    out = np.zeros(len(vocabulary), np.int64)
    for term, n in index.select("terms", "counts").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():  # at most one row per test term
        out[term] = n
    return out


def _look_up(keys: np.ndarray, plan: list, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, place of its first word) for all places where each term lies within slop of its offset."""
    found_phrase, found_place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for which, terms, offsets in plan:
        lo = np.searchsorted(keys, terms[:, 0].astype(np.uint64) << _POS)
        hi = np.searchsorted(keys, (terms[:, 0] + 1).astype(np.uint64) << _POS)
        row = np.repeat(np.arange(len(which)), hi - lo)
        place = (keys[ranges(lo, hi - lo)] & np.uint64(0xFFFFFFFF)).astype(np.int64) - offsets[row, 0]
        if slop:
            row = np.repeat(row, 2 * slop + 1)
            place = np.repeat(place, 2 * slop + 1) + np.tile(np.arange(-slop, slop + 1), len(place))
        for j in range(1, terms.shape[1]):
            if not len(row):
                break
            key = (terms[row, j].astype(np.uint64) << _POS).astype(np.int64)
            target = place + offsets[row, j]
            ok = target + slop >= 0
            at = np.searchsorted(keys, (key + np.maximum(target - slop, 0)).view(np.uint64))
            ok &= at < len(keys)
            ok[ok] = keys[at[ok]] <= (key[ok] + target[ok] + slop).view(np.uint64)
            row, place = row[ok], place[ok]
        found_phrase.append(which[row])
        found_place.append(place)
    return np.concatenate(found_phrase), np.concatenate(found_place)


def _match(sent, gap: int):
    """Matches of the broadcast (items, items' nulls, vocabulary, searches), each search a kind, its phrases, their plan and slop."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("windows", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, none, vocabulary, searches = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                terms, counts = _shard_terms(row)
                term, at = _known(terms, vocabulary)
                if not len(term):
                    continue
                starts = np.cumsum(counts) - counts
                keys = (np.repeat(term.astype(np.uint64), counts[at]) << _POS) | unpacked(row["places"])[ranges(starts[at], counts[at])]
                docs, nulls, names = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["keys"], np.int64).reshape(-1, 2)
                bounds = unpacked_rising(row["bounds"], len(docs)).astype(np.int64)
                for kind, phrases, plan, slop in searches:
                    phrase, place = _look_up(keys, plan, slop)
                    if not len(phrase):
                        continue
                    item, length = phrases.item[phrase], phrases.length[phrase]
                    # a match lies wholly in one document, as documents are `gap` places apart; slop may put its start before the text
                    doc = np.searchsorted(bounds, place + slop, "right") - 1
                    first = np.maximum(place - bounds[doc], 0)
                    order = np.lexsort((phrase, item, doc))
                    doc, item, phrase, first, length = (x[order] for x in (doc, item, phrase, first, length))
                    heads, _ = runs(doc * len(items) + item)
                    distinct = np.add.reduceat(np.r_[True, (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1])].astype(np.int64), heads)
                    d, i = doc[heads], item[heads]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(names[d, k]) for k in (0, 1)),
                            pa.array(docs[d], mask=nulls[d]),
                            pa.array(items[i], mask=none[i]),
                            pa.array([kind] * len(heads)),
                            pa.array(distinct),
                            pa.array(np.minimum.reduceat(first, heads)),
                            pa.array(np.maximum.reduceat(first + length - 1, heads)),
                        ],
                        schema=schema,
                    )

    return run


def matches(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, near_phrase: int = NEAR_PHRASE, slop: int = SLOP) -> DataFrame:
    """Where documents (doc_id, text) hold passages of benchmark (item_id, text): a row per document row, item and kind.

    exact: some window of `phrase` words of the item stands in the document word for word (an item of fewer words is one
    window). proximity: for some window of `near_phrase` words (items of fewer than `phrase` words have none) there is a place p
    such that the window's word j occurs within `slop` words of p + j, for every j. windows counts the distinct windows matched;
    first_word and last_word span them, in folded words of the document. Null or empty texts on either side match nothing; null
    doc_id or item_id stay null; repeated rows of docs are reported apiece, repeated items apiece; other columns don't matter.
    """
    return _found(docs, benchmark, phrase, near_phrase, slop).drop("a", "b")


def _found(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, near_phrase: int = NEAR_PHRASE, slop: int = SLOP) -> DataFrame:
    """matches() with the row_key of each document."""
    test = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rough = test.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(rough / 2 / TEST_WORDS_AT_ONCE))
    gap = near_phrase + 4 * slop + phrase
    corpus = index(docs, gap) if rough else None
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for k in range(blocks):
        part = test if blocks == 1 else test.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        if (found := _search(docs.sparkSession, corpus, part.collect() if rough else [], gap, phrase, near_phrase, slop)) is not None:
            out = found if blocks == 1 else out.unionByName(found)
    return out


def _search(spark: SparkSession, corpus: DataFrame, test: list, gap: int, phrase: int, near_phrase: int, slop: int) -> DataFrame | None:
    items, none = np.array([r[0] or 0 for r in test], np.int64), np.array([r[0] is None for r in test], bool)
    texts = [r[1] for r in test]
    exact, near = Phrases(texts, phrase), Phrases(texts, near_phrase, phrase)
    if not len(exact.item):
        return None
    vocabulary = np.unique(np.concatenate([hashes.ravel() for _, hashes in exact.by_length]))
    frequency = _frequency(corpus, vocabulary)
    searches = [(kind, p, p.plan(vocabulary, frequency), s) for kind, p, s in (("exact", exact, 0), ("proximity", near, slop)) if len(p.item)]
    for _, p, _, _ in searches:
        p.by_length = []
    return corpus.mapInArrow(_match(spark.sparkContext.broadcast((items, none, vocabulary, searches)), gap), _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, **settings: int) -> DataFrame:
    """docs without the rows that matches() reports, exact or by proximity; all columns stay.

    Rows are judged apiece, by all their columns: rows of null doc_id go where they match, and of two texts under one doc_id only the one that matches goes.
    Null and empty texts stay; repeated rows go or stay together; an empty table stays empty; columns may have any names.
    """
    return only(docs, _found(docs, benchmark, **settings).select("a", "b"))
