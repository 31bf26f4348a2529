"""One-at-a-time hashes of 64 and 32 bits, in wrapping arithmetic, and a Bloom filter over 64-bit keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def joaat64(texts: list[str | None]) -> np.ndarray:
    """Hash of each text's UTF-8 bytes, as signed numbers; the texts of a batch advance together, a byte a step."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) for r in raw], np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(raw[k] for k in order), np.uint8)
    lengths = lengths[order]
    starts = np.cumsum(lengths) - lengths
    h = np.zeros(len(raw), np.int64)
    live = len(raw)
    for k in range(int(lengths[0]) if len(raw) else 0):
        while live and lengths[live - 1] <= k:
            live -= 1
        x = h[:live]
        x += data[starts[:live] + k]
        x += x << 20
        x ^= x >> 12
    h += h << 6
    h ^= h >> 22
    h += h << 30
    out = np.empty_like(h)
    out[order] = h
    return out


def joaat32(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """32-bit hash of 64-bit numbers: the steps of the hash over the low and the high half."""
    x = np.asarray(x, np.int64)
    h = np.full(len(x), seed, np.int32)
    for half in ((x & 0xFFFFFFFF).astype(np.uint32).view(np.int32), (x.view(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)):
        h += half
        h += h << 10
        h ^= h >> 6
    h += h << 3
    h ^= h >> 11
    h += h << 15
    return h


def url_hash(url: Column) -> Column:
    """joaat64 of a column; null for null. xxhash64 is the quicker key where the value itself doesn't matter."""

    @F.pandas_udf("bigint")
    def run(urls: pd.Series) -> pd.Series:
        return pd.Series(joaat64(urls.tolist())).where(urls.notna().to_numpy(), None).astype("Int64")

    return run(url)


class BloomFilter:
    """Set of 64-bit keys that may answer yes wrongly: `bits` bits and `hashes` places a key."""

    def __init__(self, expected: int, false_positives: float = 0.01):
        self.bits = max(64, int(np.ceil(-expected * np.log(false_positives) / np.log(2) ** 2)))
        self.hashes = max(1, round(self.bits / max(1, expected) * np.log(2)))
        self.set = np.zeros(self.bits, bool)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([joaat32(keys, seed).view(np.uint32).astype(np.int64) % self.bits for seed in range(self.hashes)])

    def add(self, keys: np.ndarray) -> None:
        self.set[self._places(keys)] = True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return self.set[self._places(keys)].all(0)

    def union(self, other: BloomFilter) -> BloomFilter:
        if (self.bits, self.hashes) != (other.bits, other.hashes):
            raise ValueError("filters of different sizes")
        self.set |= other.set
        return self
