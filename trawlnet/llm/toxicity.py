"""Toxicity by class-conditional Kneser-Ney models of characters.

Two models, of toxic and of ordinary texts, give the log-likelihood of a text; the score is their difference per character, as if
`PRIOR` characters more were neutral. A model's orders from `ORDER` characters down to `SHARED` + 1 have counts of its class (continuation counts
below the highest) with absolute discounting. What they discount goes in the end to orders that both classes share: continuation counts over the
whole corpus, labelled or not, so that an expression too rare for either class is judged alike by both. The class counts are of labelled texts of up to `FIT_CHARS`
characters a class, the first in the order of a hash of doc_id; that bounds what is sent to every executor. The threshold is the one of best F1 on
labelled texts that the models in use for it haven't seen.

A character is a symbol of 12 bits: its code point in lower case below 4096 (white space is one symbol, so are digits), above that a hash of it. Five symbols
are one 60-bit code, so all scripts have expressions of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blob, bucket_of, buckets, checkpointed, column, exchange, packed_rising, runs, split, unpacked_rising
from .textkit import chunks, mix

ORDER = 5
SHARED = 2
DISCOUNT = 0.75
PRIOR = 100
#: Characters of labelled texts that each class's counts are taken from, at most.
FIT_CHARS = 12_000_000
#: Of this many parts of the labelled documents, by hash of doc_id, one is held out to set the threshold.
PARTS = 5
#: Labelled rows that are sent to every executor; more are joined by a shuffle.
LABELS_AT_ONCE = 4_000_000
SCORES = "doc_id bigint, n_symbols bigint, log_ratio double, toxic boolean"
_BITS = 12
_SYMBOLS = 1 << _BITS
_SLOTS = 1 << 12


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << _BITS * order) - 1)


def _symbol_table() -> np.ndarray:
    """Symbol of each code point below 4096."""
    table = np.arange(_SYMBOLS, dtype=np.uint64)
    for k in range(_SYMBOLS):
        c = chr(k)
        table[k] = 0 if c.isspace() else ord("0") if c.isdigit() else min(ord(c.lower()[0]), _SYMBOLS - 1)
    return table


_table: list[np.ndarray] = []


def codes(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The code of the last `order` symbols at each character, and where each text begins in them (len + 1). Texts begin after spaces."""
    if not _table:
        _table.append(_symbol_table())
    lengths = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _table[0][np.minimum(points, _SYMBOLS - 1)]
    high = np.flatnonzero(points >= _SYMBOLS)
    symbols[high] = mix(points[high]) >> np.uint64(64 - _BITS)
    symbols[high[np.isin(points[high], [0x3000, 0x2028, 0x2029, 0x205F, 0x202F, 0x1680, *range(0x2000, 0x200B)])]] = 0
    bounds = np.r_[0, np.cumsum(lengths)]
    out = symbols.copy()
    starts = bounds[:-1][lengths > 0]
    for k in range(1, order):
        moved = np.zeros(len(symbols), np.uint64)
        moved[k:] = symbols[:-k]
        for j in range(k):  # before a text there are spaces, whose symbol is 0
            at = starts + j
            moved[at[at < len(moved)]] = 0
        out |= moved << np.uint64(_BITS * k)
    return out, bounds


@dataclass
class Level:
    """Of one order log P(symbol | toxic) - log P(symbol | ordinary) at the codes seen in either class, and the log ratio of what is left to lower orders at the contexts."""

    order: int
    seen: np.ndarray
    at_seen: np.ndarray
    contexts: np.ndarray
    at_context: np.ndarray


def _found(names: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of wanted are among names (sorted), and where."""
    at = np.minimum(np.searchsorted(names, wanted), max(0, len(names) - 1))
    return (names[at] == wanted) if len(names) else np.zeros(len(wanted), bool), at


def ratios(levels: list[Level], wanted: np.ndarray) -> np.ndarray:
    """The log ratio at each code of ORDER symbols: where a code wasn't seen, what its context leaves and the ratio of its suffix."""
    out = np.zeros(len(wanted))
    for level in levels:
        mine = wanted & _mask(level.order)
        ok, at = _found(level.contexts, mine >> np.uint64(_BITS))
        out[ok] += level.at_context[at[ok]]
        ok, at = _found(level.seen, mine)
        out[ok] = level.at_seen[at[ok]]
    return out


class Shared:
    """Probability of a symbol after the one before it, from the corpus's continuation counts: for each pair of symbols the number of distinct symbols before it."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray):
        self.pairs, self.counts = pairs, counts.astype(float)
        self.contexts, starts, self.types = np.unique(pairs >> np.uint64(_BITS), return_index=True, return_counts=True)
        self.totals = np.add.reduceat(self.counts, starts) if len(starts) else np.zeros(0)
        self.symbols, n = np.unique(pairs & _mask(1), return_counts=True)
        self.single = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * len(n) / _SYMBOLS) / max(1, n.sum())

    def probability(self, wanted: np.ndarray) -> np.ndarray:
        ok, at = _found(self.symbols, wanted & _mask(1))
        low = np.full(len(wanted), DISCOUNT * max(1, len(self.symbols)) / _SYMBOLS / max(1, len(self.pairs)))
        low[ok] = self.single[at[ok]]
        known, at = _found(self.contexts, wanted >> np.uint64(_BITS))
        ok, place = _found(self.pairs, wanted)
        n = np.zeros(len(wanted))
        n[ok] = self.counts[place[ok]]
        out = low.copy()
        out[known] = (np.maximum(n[known] - DISCOUNT, 0) + DISCOUNT * self.types[at[known]] * low[known]) / self.totals[at[known]]
        return out


def kneser_ney(seen: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, shared: Shared, order: int = ORDER) -> list[Level]:
    """Levels, the lowest order first, from the counts of the codes seen in either class; seen is sorted and distinct."""
    return _levels(seen, [toxic.astype(float), ordinary.astype(float)], shared, order)[1]


def _levels(seen: np.ndarray, counts: list[np.ndarray], shared: Shared, order: int) -> tuple[list[np.ndarray], list[Level]]:
    """P(symbol | context) of each class at the codes, and the levels."""
    if order == SHARED:
        p = shared.probability(seen)
        return [p, p], []
    names, at = np.unique(seen & _mask(order - 1), return_inverse=True)
    lower, levels = _levels(names, [np.bincount(at, (n > 0).astype(float), len(names)) for n in counts], shared, order - 1)
    context = seen >> np.uint64(_BITS)
    starts, lengths = runs(context)
    found, rest = [], []
    for n, p in zip(counts, lower):
        total = np.add.reduceat(n, starts) if len(starts) else np.zeros(0)
        types = np.add.reduceat((n > 0).astype(float), starts) if len(starts) else np.zeros(0)
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        found.append(np.maximum(n - DISCOUNT, 0) / np.repeat(np.maximum(total, 1), lengths) + np.repeat(left, lengths) * p[at])
        rest.append(np.log(left))
    level = Level(order, seen, np.log(found[0] / found[1]).astype(np.float32), context[starts], (rest[0] - rest[1]).astype(np.float32))
    return found, [*levels, level]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per label, part and code of what this task sees, in buckets of codes."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return names, np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)

    for piece in chunks(batches):
        texts = np.array(piece.column("text").to_pylist(), object)
        labels, parts = piece.column("toxic").to_numpy(), piece.column("part").to_numpy()
        held_out = (parts == 0).astype(int)
        for label, out in {(int(a), int(b)) for a, b in zip(labels, held_out)}:
            own, _ = codes(list(texts[(labels == label) & (held_out == out)]))
            names, n = np.unique(own, return_counts=True)
            held.setdefault((label, out), []).append((names, n))
            size += len(names)
        if size > 4 << 20:
            held = {k: [merged(v)] for k, v in held.items()}
            size = sum(len(v[0][0]) for v in held.values())
    for (label, out), v in held.items():
        names, n = merged(v)
        for b, (x, y) in split(bucket_of(mix(names), 8), 8, names, n):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "kind": pa.array([2 * label + out], pa.int32()), "codes": [blob(x)], "counts": [blob(y)]})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for k, kind in enumerate(batch.column("kind").to_pylist()):
            row = batch.slice(k, 1)
            held.setdefault(kind, []).append((column(row, "codes", np.uint64).copy(), column(row, "counts", np.int64).copy()))
    for kind, parts in held.items():
        names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "codes": [blob(names)], "counts": [blob(n)]})


def _trigrams(n: int):
    """The distinct codes of SHARED + 1 symbols of a task's texts, in buckets of their last SHARED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for piece in chunks(batches):
            held.append(np.unique(codes(piece.column("text").to_pylist(), SHARED + 1)[0]))
            if len(held) == 16:
                held = [np.unique(np.concatenate(held))]
        own = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        for b, (x,) in split(bucket_of(mix(own & _mask(SHARED)), n), n, own):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "codes": [len(x).to_bytes(8, "little") + packed_rising(x)]})

    return run, "bucket int, codes binary"


def _continuations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every = [unpacked_rising(x[8:], int.from_bytes(x[:8], "little")) for batch in batches for x in batch.column("codes").to_pylist()]
    if every:
        names, n = np.unique(np.unique(np.concatenate(every)) & _mask(SHARED), return_counts=True)
        yield pa.RecordBatch.from_pydict({"codes": [blob(names)], "counts": [blob(n.astype(np.int64))]})


def shared_counts(docs: DataFrame) -> Shared:
    """The continuation counts of all texts of the corpus; at most a row of 16 bytes for each of the 4096 * 4096 pairs of symbols reaches the driver."""
    n = buckets(docs.sparkSession)
    rows = exchange(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(*_trigrams(n))).mapInArrow(_continuations, "codes binary, counts binary").collect()
    names = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    order = np.argsort(names)
    return Shared(names[order], counts[order])


def _scorer(sent, lowest: float | None):
    """Maps (doc_id, text, ...) to scores under broadcast levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            own, bounds = codes(piece.column("text").to_pylist())
            names, at = np.unique(own, return_inverse=True)
            total = np.r_[0.0, np.cumsum(ratios(sent.value, names)[at])]
            n = np.diff(bounds)
            score = (total[bounds[1:]] - total[bounds[:-1]]) / (n + PRIOR)
            score[n == 0] = 0.0
            cols = {"doc_id": piece.column("doc_id"), "n_symbols": pa.array(n), "log_ratio": pa.array(score)}
            if lowest is None:
                cols["toxic"] = piece.column("toxic")
            else:
                cols["toxic"] = pa.array((score > lowest) & (n > 0))
            yield pa.RecordBatch.from_pydict(cols)

    return run


def labelled(docs: DataFrame, labels: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, text, toxic, part) of documents with one label or several that agree, up to fit_chars characters of each class; part 0 is held out."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most and toxic in (0, 1)").drop("most")
    few = known.limit(LABELS_AT_ONCE + 1).count() <= LABELS_AT_ONCE
    slot = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(_SLOTS)).cast("int").alias("slot")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known) if few else known, "doc_id").select("*", slot)
    sizes = rows.groupBy("toxic", "slot").agg(F.sum(F.length("text")).alias("n")).orderBy("toxic", "slot").collect()  # at most 2 * _SLOTS rows
    taken, ends = {0: 0, 1: 0}, {0: _SLOTS, 1: _SLOTS}
    for toxic, k, n in sizes:
        if ends[toxic] == _SLOTS:
            taken[toxic] += n or 0
            if taken[toxic] > fit_chars:
                ends[toxic] = k
    rows = rows.filter((F.col("toxic") == 0) & (F.col("slot") < ends[0]) | (F.col("toxic") == 1) & (F.col("slot") < ends[1]))
    return rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int").alias("part"))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The midpoint between neighbouring scores above which calling a text toxic has the best F1; infinite without toxic texts."""
    if not labels.any():
        return float("inf")
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-9)


def scores(docs: DataFrame, labels: DataFrame, fit_chars: int = FIT_CHARS) -> DataFrame:
    """(doc_id, n_symbols, log_ratio, toxic) for each row of docs (doc_id, text), learnt from labels (doc_id, toxic 0 or 1).

    log_ratio is the sum over the text's characters of log P(toxic model) - log P(ordinary model), over the characters and PRIOR more. A null or empty text scores 0.0 and isn't
    toxic. Labels that are null, contradict each other or have no document are left out; without labelled texts of both classes all ratios are 0.0 and nothing is
    toxic. Of a class with more labelled text than fit_chars the first in an order by hash are learnt from. A null doc_id stays null; repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    known = checkpointed(labelled(docs, labels, fit_chars))
    sums = exchange(known.mapInArrow(_counts, "bucket int, kind int, codes binary, counts binary"), n=8).mapInArrow(_sums, "kind int, codes binary, counts binary").collect()  # at most 2 * fit_chars codes
    every = np.unique(np.concatenate([np.frombuffer(r[1], np.uint64) for r in sums] or [np.zeros(0, np.uint64)]))
    n = np.zeros((4, len(every)), np.int64)
    for kind, names, counts in sums:
        n[kind, np.searchsorted(every, np.frombuffer(names, np.uint64))] += np.frombuffer(counts, np.int64)
    if not (n[0] + n[1]).any() or not (n[2] + n[3]).any():
        return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_symbols"), F.lit(0.0).alias("log_ratio"), F.lit(False).alias("toxic"))
    shared = shared_counts(docs)
    fitted = (n[0] + n[2]) > 0
    held_out = known.filter("part = 0")
    lowest = 0.0
    if n[0].any() and n[2].any():
        part = spark.sparkContext.broadcast(kneser_ney(every[fitted], n[2][fitted], n[0][fitted], shared))
        rows = held_out.mapInArrow(_scorer(part, None), "doc_id bigint, n_symbols bigint, log_ratio double, toxic int").filter("n_symbols > 0").groupBy((F.round(F.col("log_ratio") * 1e6)).cast("bigint").alias("s"), "toxic").agg(F.count("*").alias("n")).collect()
        s = np.repeat([r[0] / 1e6 for r in rows], [r[2] for r in rows])
        y = np.repeat([r[1] for r in rows], [r[2] for r in rows])
        lowest = best_threshold(s, y) if y.any() else 0.0
        part.destroy()
    ratio = spark.sparkContext.broadcast(kneser_ney(every, n[2] + n[3], n[0] + n[1], shared))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(ratio, lowest), SCORES)
