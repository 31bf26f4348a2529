"""Best-fit packing of documents into token sequences of a fixed length, with exact-complement hashing first.

Documents are cut into pieces of at most `capacity` tokens. How many pieces there are of each length is all that planning
needs: it runs on that histogram, of at most `capacity` numbers, however large the corpus.

1. For each length, longest first, the gap it leaves is looked up among the available single lengths, then in an
   index of pair sums, then of triple sums, which hold the parts; every combination found is used as often as its scarcest length allows.
2. What no combination completes is packed by best fit, longest first.

The plan is a list of patterns (lengths in a bin, number of such bins). Pieces are numbered within their length by salted
windows and look their bin up in the plan.
"""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets, checkpointed
from .textkit import chunks, mix, powers, text_bytes
from .textkit import _BASE, _INVERSE, _SPACE, _TABLE

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Public pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = "bin_id bigint, doc_id bigint, piece int, start_token bigint, n_tokens int"
#: Segments whose token counts a worker remembers before it forgets them all; only speed depends on it.
REMEMBERED = 300_000


class TokenCounter:
    """Token counts of texts under a vocabulary file (base64 token and rank per line), by remembered segments.

    A segment is a run of ASCII white space and the word after it. The pattern joins nothing across the start of a segment, so a
    text's tokens are those of its segments; a text with other white space is encoded as a whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, int] = {}

    def count(self, texts: pa.Array) -> np.ndarray:
        raw, offsets = text_bytes(texts)
        n, texts_n = len(raw), len(offsets) - 1
        out = np.zeros(texts_n, np.int64)
        if not n:
            return out
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        # a segment ends where a word does, or where a text does
        ends = np.flatnonzero((~space & np.r_[space[1:], True]) | edge[1:]) + 1
        starts = np.r_[0, ends[:-1]]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[raw] * powers(_BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
        names, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        known, data = self.known, raw.tobytes()
        counts = np.fromiter((known.get(h, 0) for h in names.tolist()), np.int64, len(names))
        new = np.flatnonzero(counts == 0)
        if len(new):
            if len(known) > REMEMBERED:
                known.clear()
            where = first[new]
            encode = self.encoding.encode_ordinary
            for k, a, b, h in zip(new.tolist(), starts[where].tolist(), ends[where].tolist(), names[new].tolist()):
                known[h] = counts[k] = len(encode(data[a:b].decode("utf-8", "replace")))
        owner = np.searchsorted(offsets, starts, "right") - 1
        out[:] = np.bincount(owner, counts[at], texts_n).astype(np.int64)
        pair = raw[:-1].astype(np.uint16) << 8 | raw[1:]
        odd = np.flatnonzero(np.isin(pair, [0xC2A0, 0xC285, 0xE280, 0xE281, 0xE380, 0xE19A]) | ((raw[:-1] >= 28) & (raw[:-1] < 32)))
        for k in np.unique(np.searchsorted(offsets, odd, "right") - 1):
            out[k] = len(self.encoding.encode_ordinary(data[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")))
        return out


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """The counter of this process for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for each row; null texts have 0."""
    if not os.path.exists(vocabulary):
        raise FileNotFoundError(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for piece in chunks(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counter.count(piece.column("text")))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


class _Stock:
    """Available pieces by length, and indexes of the sums of two and of three lengths.

    pairs[s] are the longer parts a of a + b = s, the longest first; the other part is s - a. triples[s] are the longest parts a of a + t = s for which t is a
    sum in pairs. Both hold what there was at first; what has been used up since is passed over by the counts.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.n = [0] * (capacity + 1)
        for length, count in counts.items():
            self.n[length] = count
        lengths = np.array(sorted(k for k, c in counts.items() if c), np.int64)
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        self.pairs = self._by_sum(a, b, (b <= a) & (a + b <= capacity))
        sums = np.flatnonzero(np.diff(self.pairs[1]))
        a, t = np.meshgrid(lengths, sums, indexing="ij")
        self.triples = self._by_sum(a, t, a + t <= capacity)

    def _by_sum(self, a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts a in the order of their sums and falling, and where each sum's begin."""
        a, total = a[ok], (a + b)[ok]
        order = np.lexsort((-a, total))
        return a[order], np.searchsorted(total[order], np.arange(self.capacity + 2))

    def parts(self, index: tuple[np.ndarray, np.ndarray], total: int) -> list[int]:
        return index[0][index[1][total] : index[1][total + 1]].tolist()

    def most(self, lengths: tuple[int, ...]) -> int:
        return min(self.n[x] // k for x, k in Counter(lengths).items())

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.n[x] -= times

    def completing(self, length: int) -> tuple[int, ...] | None:
        """Lengths that exactly fill the gap beside one of `length`: one, else two, else three, the longest first; None if there are none."""
        gap = self.capacity - length
        if gap <= 0:
            return ()
        if self.n[gap] and self.most((length, gap)):
            return (gap,)
        for a in self.parts(self.pairs, gap):
            if self.n[a] and self.n[gap - a] and self.most((length, a, gap - a)):
                return a, gap - a
        for a in self.parts(self.triples, gap):
            if a * 3 < gap:
                break
            if self.n[a]:
                for b in self.parts(self.pairs, gap - a):
                    c = gap - a - b
                    if b <= a and self.n[b] and self.n[c] and self.most((length, a, b, c)):
                        return a, b, c
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a bin, number of bins) that hold all pieces."""
    stock = _Stock(counts, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while stock.n[length]:
            rest = stock.completing(length)
            if rest is None:
                break
            lengths = (length, *rest)
            times = stock.most(lengths)
            stock.take(lengths, times)
            patterns.append((lengths, times))
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # room left: (lengths, bins)
    room = 0  # bit set of the rooms there are
    for length in range(capacity, 0, -1):
        left = stock.n[length]
        while left:
            fitting = room >> length
            if fitting:
                r = length + (fitting & -fitting).bit_length() - 1
                lengths, bins = open_bins[r].pop(0)
            else:
                r, lengths, bins = capacity, (), left
            each = r // length
            filled = min(bins, left // each)
            parts = [(filled, each)]
            if filled < bins and left > filled * each:
                parts.append((1, left - filled * each))
            used = sum(b for b, _ in parts)
            if fitting and used < bins:
                open_bins[r].insert(0, (lengths, bins - used))
            for b, k in parts:
                if b:
                    open_bins[r - k * length].append((lengths + (length,) * k, b))
                    room |= 1 << (r - k * length)
                    left -= b * k
            if fitting and not open_bins[r]:
                room &= ~(1 << r)
    return patterns + [p for r in sorted(open_bins) for p in open_bins[r]]


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, pieces per bin, first bin) of each pattern's pieces of a length, sorted."""
    used: dict[int, int] = defaultdict(int)
    out, bin_id = [], 0
    for lengths, bins in patterns:
        for length, k in Counter(lengths).items():
            out.append((length, used[length], k, bin_id))
            used[length] += k * bins
        bin_id += bins
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, piece, start_token, n_tokens): the bin of each piece of docs (doc_id, text).

    Every token of every document is in just one piece, and no bin holds more than `capacity` tokens. A text without tokens (null or
    empty) has no piece; a row of null doc_id is packed under a null doc_id; repeated rows are packed apiece; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return packed_lengths(token_counts(docs, vocabulary), capacity)


def packed_lengths(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The same for rows (doc_id, n_tokens): null, zero and negative numbers have no piece, a null doc_id stays null, repeated rows are packed apiece, an empty table has no bins."""
    spark = lengths.sparkSession
    salts = buckets(spark)
    lengths = checkpointed(lengths.filter("n_tokens > 0"))
    pieces = lengths.select(
        "doc_id",
        F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n_tokens") - 1, F.lit(capacity).cast("bigint"))).alias("piece", "start_token"),
        "n_tokens",
    ).withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("start_token")).cast("int"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    by_salt = checkpointed(pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in by_salt.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan(counts, capacity))
    before = by_salt.select("n_tokens", "salt", (F.sum("n").over(W.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(W.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece"))).join(before, ["n_tokens", "salt"])
    ranked = ranked.select("doc_id", "piece", "start_token", "n_tokens", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = slots[:, 0] << np.int64(44) | slots[:, 1]
        for batch in batches:
            rank, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("rank", "n_tokens"))
            at = np.searchsorted(key, n << np.int64(44) | rank, "right") - 1
            bins = slots[at, 3] + (rank - slots[at, 1]) // slots[at, 2]
            yield pa.RecordBatch.from_arrays([pa.array(bins), *(batch.column(c) for c in ("doc_id", "piece", "start_token", "n_tokens"))], ["bin_id", "doc_id", "piece", "start_token", "n_tokens"])

    return ranked.mapInArrow(run, BINS)
