"""Quality rules from suffix arrays: how much of a text is repeated, and how long its longest repeat is.

Per document, a suffix array over the words is built by prefix doubling; the longest common prefixes of neighbours
in it delimit intervals of suffixes, and each interval is a maximal repeated substring. The union of the spans of all
repeats of at least `min_words` words is the covered part; shorter repeats, and whole lines that come again, have limits of their own. All documents of a piece are sorted
together, keyed by document, so that the work is a few array sorts instead of a loop over documents. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, chunks, mix, text_bytes, words

MIN_WORDS = 16
MAX_COVERED = 0.3
MAX_REPEAT = 100
#: Words of a shorter repeat and the fraction that such ones may cover; those not under min_words don't apply.
SHORT = ((8, 0.4), (4, 0.6))
MAX_LINES = 0.3
SCHEMA = "doc_id bigint, n_words int, covered_words int, covered_fraction double, longest_repeat int, longest_any int, fraction_8 double, fraction_4 double, line_fraction double, keep boolean"


def suffix_levels(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of all texts (by text, then by words) and, for level k, the class of each suffix by its first 2**k words."""
    n = len(codes)
    key = owner.astype(np.int64) * (int(codes.max()) + 1) + codes if n else np.zeros(0, np.int64)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, k = [rank], 1
    active = np.arange(n)
    while len(active):
        starts, lengths = _runs(rank[sa[active]])
        active = active[np.repeat(lengths > 1, lengths)]
        if not len(active):
            break
        suffix = sa[active]
        ahead = suffix + k
        inside = ahead < n
        inside[inside] = owner[ahead[inside]] == owner[suffix[inside]]
        second = np.zeros(len(suffix), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[suffix] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        suffix, key = suffix[order], key[order]
        sa[active] = suffix
        head = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[suffix] = active[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        levels.append(rank)
        k *= 2
    return sa, levels


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return starts, np.diff(np.r_[starts, len(values)])


def common_prefixes(sa: np.ndarray, levels: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the words that its suffix shares with the one before (0 across texts)."""
    n = len(sa)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[at - 1].copy(), sa[at].copy()
    begun = b.copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        ok[ok] = owner[a[ok]] == owner[b[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
    out[at] = b - begun
    return out


def measure(w: Words, *minima: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words covered by repeats of at least so many words, for each of minima, and the longest repeat of all, for each text."""
    n, texts = len(w.hashes), len(w.bounds) - 1
    covered, longest = [np.zeros(texts, np.int64) for _ in minima], np.zeros(texts, np.int64)
    if not n:
        return covered, longest
    owner = w.owner
    _, codes = np.unique(w.hashes, return_inverse=True)
    sa, levels = suffix_levels(codes, owner)
    lcp = common_prefixes(sa, levels, owner)
    np.maximum.at(longest, owner[sa], lcp)
    for out, least in zip(covered, minima):
        lcp_here = np.where(lcp < least, 0, lcp)
        reach = np.maximum(lcp_here, np.r_[lcp_here[1:], 0])
        hit = np.flatnonzero(reach)
        starts, reach = sa[hit], reach[hit]
        edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + reach, minlength=n + 1)
        inside = np.r_[0, np.cumsum(np.cumsum(edges[:n]) > 0)]
        out[:] = inside[w.bounds[1:]] - inside[w.bounds[:-1]]
    return covered, longest


def repeated_lines(texts: pa.Array, w: Words) -> np.ndarray:
    """Words of each text in lines (to a line feed) whose words stand in another line of it too."""
    out = np.zeros(len(w.bounds) - 1, np.int64)
    if not len(w.hashes):
        return out
    raw, offsets = text_bytes(texts)
    owner = w.owner
    line = np.cumsum(raw == 10)[w.starts + offsets[owner]] + owner
    starts, lengths = _runs(line)
    place = np.arange(len(line)) - np.repeat(starts, lengths)
    name = np.add.reduceat(mix(w.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts)
    of = owner[starts]
    _, at, count = np.unique(mix(name + mix(of.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    again = count[at] > 1
    np.add.at(out, of[again], lengths[again])
    return out


def measured(texts: pa.Array, min_words: int, max_covered: float, max_repeat: int) -> dict[str, np.ndarray]:
    """The columns of SCHEMA after doc_id, for each text."""
    w = words(texts)
    short = [(least, limit) for least, limit in SHORT if least < min_words]
    (covered, *shorter), longest = measure(w, min_words, *(least for least, _ in short))
    n = np.maximum(w.counts, 1)
    fractions, lines = [c / n for c in shorter], repeated_lines(texts, w) / n
    keep = (covered / n <= max_covered) & (longest <= max_repeat) & (lines <= MAX_LINES)
    for fraction, (_, limit) in zip(fractions, short):
        keep &= fraction <= limit
    named = {f"fraction_{least}": np.full(len(n), np.nan) for least, _ in SHORT} | {f"fraction_{least}": f for (least, _), f in zip(short, fractions)}
    return {"n_words": w.counts, "covered_words": covered, "covered_fraction": covered / n, "longest_repeat": np.where(longest < min_words, 0, longest), "longest_any": longest, **named, "line_fraction": lines, "keep": keep}


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row for each row of docs (doc_id, text): words, words covered by repeats, their fraction, longest repeat, keep.

    A document is kept when at most `max_covered` of its words lie in repeats of at least `min_words` words, no repeat is longer than
    `max_repeat` words, repeats of the lengths of SHORT cover no more than their limits (fraction_8 and fraction_4; null where min_words is no more than that), and at most MAX_LINES of its words
    stand in lines that come again (line_fraction). longest_any is the longest repeat of all, longest_repeat the same where it has min_words words, else 0. A
    null or empty text has no words, fraction 0.0, and is kept; a null doc_id stays null; repeated rows give repeated results; other
    columns are ignored. Occurrences of a repeat may overlap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            m = measured(piece.column("text"), min_words, max_covered, max_repeat)
            integers = ("n_words", "covered_words", "longest_repeat", "longest_any")
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(v, pa.int32() if k in integers else None, from_pandas=True) for k, v in m.items())], ["doc_id", *m])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns, in the same pass over the texts.

    Null and empty texts are kept, whatever the doc_id; repeated rows go or stay together; an empty table stays empty; columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches):
            keep = measured(piece.column("text"), min_words, max_covered, max_repeat)["keep"]
            yield piece if keep.all() else piece.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
