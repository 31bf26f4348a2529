"""Vectorised word tokens of Arrow text columns, shared by the operators of this subpackage.

A *word* is a maximal run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r). Words are
named by a 64-bit polynomial hash that is computed for a whole Arrow buffer at once, so no Python
object is made per word. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; it bounds the memory of a Python worker, not the length of a text.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.default_rng(20240117).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.cumprod(out, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """Words of a run of texts: hash, byte span within the text, and for text k the words bounds[k]:bounds[k+1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that the texts of a piece have about `size` bytes; a longer text is a piece of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(lengths), 0
        while at < n:
            limit = (total[at - 1] if at else 0) + size
            to = max(at + 1, int(np.searchsorted(total, limit, "right")))
            yield batch.slice(at, to - at)
            at = to
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on, and the next task may be another's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes and the offsets of each (len + 1), starting at 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Words of each text; `table`, if given, maps each byte before hashing and decides what is space (value 32)."""
    raw, offsets = text_bytes(texts)
    if table is not None:
        raw = table[raw]
    n = len(raw)
    space = np.ones(n + 1, bool)
    np.take(_SPACE, raw, out=space[:n])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~space[:n]
    begins = solid.copy()
    begins[1:] &= space[: n - 1] | edge[1:n]
    finish = solid & (space[1:] | edge[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers(_BASE, n), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(hashes, starts - offsets[owner], ends - offsets[owner], bounds)


def folding_table() -> np.ndarray:
    """Byte map for matching: ASCII letters to lower case, other ASCII non-alphanumerics to space; bytes of longer characters stay."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return table


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of hashes[i:i+k] for each i up to len - k (empty when shorter); windows ignore where texts end."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n)[: n - k + 1])


def window_mask(bounds: np.ndarray, k: int) -> np.ndarray:
    """For each window of k over all words whether it lies within one text."""
    n = int(bounds[-1])
    ok = np.ones(max(0, n - k + 1), bool)
    for shift in range(1, k):
        cut = bounds[1:-1] - shift
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i up to len - w."""
    step, out = 1, x
    while step * 2 <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    if step < w:
        out = np.minimum(out[: len(out) - (w - step)], out[w - step :])
    return out
