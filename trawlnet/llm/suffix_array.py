"""Repeated passages from a distributed suffix array over words, built with a difference cover of period three.

The texts are cut down to the regions that could hold a repeated passage: words around
fingerprints that occur twice, chosen by winnowing, which guarantees one in every window of `min_words` words (Schleimer and others, 2003). A home's
regions are joined to one text, 0 between them and a symbol of its own at the end. Words are 39 bits of
their hashes: that two different words are one symbol (1 in 10**11) would have to befall each word in which two passages differ. Numbers travel
in as many bytes as the largest of a row needs.

Down: the suffixes at places 1 and 2 modulo 3 are the sample. A home sends the distinct triples of symbols there, once each however often it has them; they are sorted over all
partitions by range and named by their rank among the distinct ones; the names, those of places 1 before those of places 2, are the text of the next level. The recursion ends when
all names are distinct, so that they are the ranks of the sample.

Up: the ranks of a level's sample come from the level above it. Places 0 modulo 3 are sorted by their symbol and the rank of the next
place, and merged with the sample by the difference-cover comparisons, range by range. Borders of ranges are suffixes, at even distances in the order of all, so
that no range is large, however often a passage or its first words occur. The lowest merge has the suffix array of the regions in order; suffixes next to each other, in a range or over its border,
whose first min_words words are the same begin repeated passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, checkpointed, exchange, forget, joined, packed, packed_rising, split, unpacked, unpacked_rising
from .passages import HOME_END, MIN_WORDS, RECORD_SPANS, REGIONS, around, homes_of, is_shared, known_rows, region_text, rows_of, shared_keys, spans_at, spread
from .textkit import sliding_min, window_hashes, window_mask

FINGERPRINT = 16
#: Triples, and suffixes, of a home that choose the borders of the ranges.
SAMPLES = 64
#: Homes, and ranges, up to which there are as many as buckets; beyond, there is one of each for so many buckets, at least as many as these.
_HOMES, _JOINED = 64, 4


def homes_for(n: int) -> int:
    """Homes and ranges for n buckets. In each of some thirty exchanges all homes send to all ranges, which takes time by the square of their number whatever the input."""
    return max(min(n, _HOMES), -(-n // _JOINED))


def ranges_for(homes: int, level: int) -> int:
    """Ranges of a level: its text has two thirds of the words of the one below."""
    return max(1, -(-homes * 2**level // 3**level))


def winnowed(symbols: np.ndarray, bounds: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of min_words words in one text that fingerprint of k words whose hash is least, the last of equals: places and hashes."""
    width = min_words - k + 1
    h = window_hashes(symbols, k)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ok = window_mask(bounds, min_words)
    least = sliding_min(h, width)
    # the place of the least is found from the right, once for each hash that is the least of some window
    chosen = np.zeros(len(h), bool)
    for lo in range(0, len(least), 1 << 16):
        part = least[lo : lo + (1 << 16)]
        good = ok[lo : lo + len(part)]
        block = np.lib.stride_tricks.sliding_window_view(h[lo : lo + len(part) + width - 1], width)
        change = np.r_[True, (part[1:] != part[:-1])] | (np.arange(len(part)) % 8 == 0)
        todo = np.flatnonzero(good & change)
        at = width - 1 - np.argmax(block[todo][:, ::-1] == part[todo][:, None], axis=1)
        chosen[lo + todo + at] = True
        rest = np.flatnonzero(good & ~change)
        if len(rest):  # the same least as the window before: chosen unless it left or came again
            last = lo + rest + width - 1
            chosen[last[h[last] == part[rest]]] = True
            gone = rest[h[lo + rest - 1] == part[rest]]
            at = width - 1 - np.argmax(block[gone][:, ::-1] == part[gone][:, None], axis=1)
            chosen[lo + gone + at] = True
            unsure = rest[~good[np.maximum(rest - 1, 0)]]
            at = width - 1 - np.argmax(block[unsure][:, ::-1] == part[unsure][:, None], axis=1)
            chosen[lo + unsure + at] = True
    place = np.flatnonzero(chosen)
    return place, h[place]


def _anchors(row: dict, min_words: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A home's winnowed fingerprints: places and hashes."""
    table = np.frombuffer(row["texts"], np.int64).reshape(-1, 3)
    ends = np.cumsum(table[:, 2])
    at, key = winnowed(unpacked(row["symbols"]), np.r_[0, ends], min_words, k)
    return at + np.searchsorted(ends, at, "right"), key  # texts are a place apart


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """x moved k places to the front, 0 at the end."""
    return np.r_[x[k:], np.zeros(min(k, len(x)), x.dtype)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def triples(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sample places of s, the number of each one's triple among the distinct ones, those in order, and how often each occurs."""
    at = np.flatnonzero(np.arange(len(s)) % 3)
    t = [s[at], _ahead(s, 1)[at], _ahead(s, 2)[at]]
    order = np.lexsort(t[::-1])
    t = [x[order] for x in t]
    head = np.r_[True, (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]) | (t[2][1:] != t[2][:-1])][: len(at)]
    number = np.empty(len(at), np.int64)
    number[order] = np.cumsum(head) - 1
    return at, number, [x[head] for x in t], np.diff(np.r_[np.flatnonzero(head), len(at)])


def _even(n: int) -> np.ndarray:
    """Up to SAMPLES of n places, evenly, the same ones each time."""
    return np.unique(np.linspace(0, max(0, n - 1), min(n, SAMPLES), dtype=np.int64))


def _triple_borders(texts: DataFrame, n: int) -> np.ndarray:
    """Borders of n ranges of the distinct triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, t, _ = triples(unpacked(row["symbols"]))
            at = _even(len(t[0]))
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)) for x in t], ["a", "b", "c"])

    found = np.array([tuple(r) for r in texts.select("symbols").mapInArrow(run, "a bigint, b bigint, c bigint").collect()], np.int64).reshape(-1, 3).view(np.uint64)  # SAMPLES a home
    found = found[np.lexsort(found.T[::-1])]
    return found[(np.arange(1, n) * len(found)) // n] if len(found) else found


def _cut(t: list[np.ndarray], borders: np.ndarray) -> np.ndarray:
    """Where the ranges begin in sorted triples: the first that isn't below each border."""
    out = []
    for border in borders:
        lo, hi = 0, len(t[0])
        for x, value in zip(t, border):
            lo, hi = lo + int(np.searchsorted(x[lo:hi], value, "left")), lo + int(np.searchsorted(x[lo:hi], value, "right"))
        out.append(lo)
    return np.array([0, *out, len(t[0])], np.int64)


def _triples(borders: np.ndarray):
    """A home's distinct triples, in order, for the ranges; repeats: whether it has one several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, t, count = triples(unpacked(row["symbols"]))
            cuts = _cut(t, borders)
            for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "home": pa.array([row["bucket"]], pa.int32()), "n": pa.array([hi - lo]), "repeats": [bool((count[lo:hi] > 1).any())], "a": [packed_rising(t[0][lo:hi])], "b": [packed(t[1][lo:hi])], "c": [packed(t[2][lo:hi])]})

    return joined(run), "bucket int, home int, n bigint, repeats boolean, a binary, b binary, c binary"


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a range's triples among its distinct ones, back to each home in its order; repeats: whether a triple occurs at several places."""
    parts = list(_rows(batches))
    if not parts:
        return
    n = np.array([p["n"] for p in parts])
    a, b, c = np.concatenate([unpacked_rising(p["a"], p["n"]) for p in parts]), np.concatenate([unpacked(p["b"]) for p in parts]), np.concatenate([unpacked(p["c"]) for p in parts])
    order = np.lexsort((c, b, a))
    x, y, z = a[order], b[order], c[order]
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(np.r_[False, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
    size = int(rank.max()) + 1
    repeats = size < len(a) or any(p["repeats"] for p in parts)
    ends = np.cumsum(n)
    for p, lo, hi in zip(parts, ends - n, ends):
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([p["home"]], pa.int32()), "source": pa.array([p["bucket"]], pa.int32()), "n": pa.array([p["n"]]), "size": pa.array([size]), "repeats": [repeats], "ranks": [packed_rising(rank[lo:hi])]})


_NAMES = "bucket int, source int, n bigint, size bigint, repeats boolean, ranks binary"


def _offsets(ranks: DataFrame, n: int) -> np.ndarray:
    """Ranks before each range, plus one: rank 0 is that of the end."""
    out = np.zeros(n, np.int64)
    for source, size in ranks.select("source", "size").distinct().collect():  # a row per range
        out[source] = size
    return np.cumsum(out) - out + 1


def _next_text(offsets: np.ndarray):
    """A home's text of the next level: names of places 1, then of places 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, replies = None, []
        for row in _rows(batches):
            if row["source"] is None:
                text = row
            else:
                replies.append(row)
        if text is None:
            return
        s = unpacked(text["symbols"])
        at, number, _, _ = triples(s)
        names = [unpacked_rising(r["ranks"], r["n"]) + np.uint64(offsets[r["source"]]) for r in sorted(replies, key=lambda r: r["source"])]
        name = np.zeros(len(s), np.uint64)
        name[at] = np.concatenate([*names, np.zeros(0, np.uint64)])[number]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([text["bucket"]], pa.int32()), "symbols": [packed(np.r_[name[1::3], name[2::3]])], "aux": [b""]})

    return run, REGIONS


def _merge_borders(text: DataFrame, up: DataFrame, n: int) -> np.ndarray:
    """Borders of n ranges of all suffixes, which are sample suffixes of places 1: rank, symbol and the next place's rank, in order."""

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = unpacked(row["symbols"])
            at = _even(len(range(2, len(s), 3)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["bucket"], np.int32)), pa.array(at), pa.array(s[1 + 3 * at].view(np.int64))], ["bucket", "at", "symbol"])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            r = unpacked(row["symbols"]).view(np.int64)
            at = _even(len(r) // 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["bucket"], np.int32)), pa.array(at), pa.array(r[at]), pa.array(r[len(r) - len(r) // 2 + at])], ["bucket", "at", "rank", "next"])

    known = {(r[0], r[1]): r[2] for r in text.select("bucket", "symbols").mapInArrow(symbols, "bucket int, at bigint, symbol bigint").collect()}  # SAMPLES a home, both
    found = sorted((r[2], known[r[0], r[1]], r[3]) for r in up.select("bucket", "symbols").mapInArrow(ranks, "bucket int, at bigint, rank bigint, next bigint").collect())
    return np.array([found[k * len(found) // n] for k in range(1, n)] if found else [], np.int64).reshape(-1, 3).view(np.uint64)


def merge_range(borders: np.ndarray, kind: np.ndarray, rank: np.ndarray, symbol: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Range of each suffix: the borders not above it. A sample suffix compares by its rank, one of places 0 by its symbol and the next place's rank."""
    out = np.searchsorted(borders[:, 0], rank, "right")
    zero = np.flatnonzero(kind == 0)
    if len(zero) and len(borders):
        first = np.unique(borders[:, 1])
        number = np.searchsorted(first, symbol[zero])
        low = np.searchsorted(borders[:, 1], symbol[zero], "left")
        same = (number < len(first)) & (first[np.minimum(number, len(first) - 1)] == symbol[zero])
        most = np.uint64(max(int(borders[:, 2].max()), int(following.max(initial=0))) + 1)
        keys = np.searchsorted(first, borders[:, 1]).astype(np.uint64) * most + borders[:, 2]
        out[zero] = np.where(same, np.searchsorted(keys, number.astype(np.uint64) * most + following[zero], "right"), low)
    return out


def _merge_items(borders: np.ndarray, min_words: int, lowest: bool, n: int):
    """All suffixes of a home with what the merge compares: two symbols, and the ranks of the sample places among the next two and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, s, up = -1, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for row in _rows(batches):
            home = row["bucket"]
            if row["source"] is None:
                s = unpacked(row["symbols"])
            else:
                up = unpacked(row["ranks"])
        if home < 0:
            return
        m = len(s)
        rank = np.zeros(m, np.uint64)
        ones = len(range(1, m, 3))
        rank[1::3], rank[2::3] = up[:ones], up[ones:]
        kind = np.arange(m) % 3
        r1, r2 = _ahead(rank, 1), _ahead(rank, 2)
        first, second = np.where(kind == 0, r1, rank), np.where(kind == 1, r1, r2)
        window = np.zeros(m, np.uint64)
        if lowest:
            h = window_hashes(s, min_words)
            window[: len(h)] = np.maximum(h, np.uint64(1))
            ends = np.flatnonzero((s == 0) | (s >= HOME_END))
            cut = np.zeros(m + 1, np.int64)
            np.add.at(cut, np.maximum(ends - min_words + 1, 0), 1)
            np.add.at(cut, ends + 1, -1)
            window[np.cumsum(cut)[:m] > 0] = 0
        t1 = _ahead(s, 1)
        bucket = merge_range(borders, kind, rank, s, r1)
        t1[kind == 1] = 0  # no comparison needs it
        for b, (p, x, y, u, v, w) in split(bucket, n, np.arange(m), s, t1, first, second, window):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "home": pa.array([home], pa.int32()), "places": [packed_rising(p)], "a": [packed(x)], "b": [packed(y)], "u": [packed(u)], "v": [packed(v)], "w": [packed(w)]})

    return joined(run), "bucket int, home int, places binary, a binary, b binary, u binary, v binary, w binary"


def merge_order(kind: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Order of suffixes by the comparisons of a difference cover of period three.

    kind is the place modulo 3. Of the sample (1, 2) u is the rank and v the rank of the next place (of kind 1) or of the one after (of kind 2);
    of kind 0 u and v are the ranks of the next two places; a and b are the first two symbols.
    """
    zero, sample = np.flatnonzero(kind == 0), np.flatnonzero(kind > 0)
    zero = zero[np.lexsort((u[zero], a[zero]))]
    sample = sample[np.argsort(u[sample], kind="stable")]
    place = np.empty(len(kind), np.int64)
    place[sample], place[zero] = np.arange(len(sample)), np.arange(len(zero))
    for k in (1, 2):
        other = sample[kind[sample] == k]
        both = np.r_[other, zero]
        is_zero = np.r_[np.zeros(len(other), bool), np.ones(len(zero), bool)]
        # a suffix of kind 1 has its next place's rank in v, one of kind 0 in u; against kind 2 both look two places on
        keys = (np.r_[v[other], u[zero]], a[both]) if k == 1 else (v[both], b[both], a[both])
        order = np.lexsort((is_zero, *keys))
        flag = is_zero[order]
        before_other, before_zero = np.cumsum(~flag), np.cumsum(flag)
        place[both[order[flag]]] += before_other[flag]
        place[both[order[~flag]]] += before_zero[~flag]
    return np.argsort(place, kind="stable")


#: Ranks of a home's places in a range, or places found; edge: the first (1) and last (2) suffix of a range, and the name of its first words.
_RANKS = "bucket int, source int, size bigint, edge int, window bigint, places binary, ranks binary"


def _by_home(bucket: int, homes: np.ndarray, places: np.ndarray, ranks: np.ndarray, n: int, size: int, edge: int = 0, window: int = 0) -> Iterator[pa.RecordBatch]:
    for h, (p, r) in split(homes.astype(np.int64), n, places, ranks):
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([h], pa.int32()), "source": pa.array([bucket], pa.int32()), "size": pa.array([size], pa.int64()), "edge": pa.array([edge], pa.int32()), "window": pa.array([window], pa.int64()), "places": [packed_rising(p)], "ranks": [packed(r)]})


def _merge(lowest: bool, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, homes, places, cols = -1, [], [], {k: [] for k in "abuvw"}
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                for k in "abuvw" if lowest else "abuv":
                    cols[k].append(unpacked(row[k]))
                places.append(unpacked_rising(row["places"], len(cols["a"][-1])).astype(np.uint32))
                homes.append(np.full(len(places[-1]), row["home"], np.int32))
        if bucket < 0:
            return
        homes, places = np.concatenate(homes), np.concatenate(places)
        a, b, u, v = (np.concatenate(cols[k]) for k in "abuv")
        order = merge_order(places % 3, a, b, u, v)
        if not lowest:
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.arange(len(order))
            yield from _by_home(bucket, homes, places, ranks, n, len(order))
            return
        w = np.concatenate(cols["w"])[order]
        same = (w[1:] == w[:-1]) & (w[1:] != 0)
        hit = np.sort(order[np.r_[same, False] | np.r_[False, same]])
        yield from _by_home(bucket, homes[hit], places[hit], np.zeros(len(hit), np.int64), n, len(order))
        for edge, k in ((1, 0), (2, -1)):
            yield from _by_home(bucket, homes[order[[k]]], places[order[[k]]], np.zeros(1, np.int64), n, len(order), edge, int(w[[k]].view(np.int64)[0]))

    return joined(run), _RANKS


def _over_borders(ranks: DataFrame) -> list[tuple[int, int]]:
    """(range, edge) of the suffixes whose first words are those of their neighbour in another range."""
    found = {(r[0], r[1]): r[2] for r in ranks.filter("edge > 0").select("source", "edge", "window").collect()}  # two rows a range
    sources = sorted({s for s, _ in found})
    out = []
    for a, b in zip(sources, sources[1:]):
        if found[a, 2] == found[b, 1] != 0:
            out += [(a, 2), (b, 1)]
    return out


def _both(texts: DataFrame, ranks: DataFrame, n: int | None = None) -> DataFrame:
    """Texts and ranks, those of a home in one partition."""
    return exchange(texts.unionByName(ranks, allowMissingColumns=True), n=n)


def _placed(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ranks = unpacked(row["ranks"])
    return unpacked_rising(row["places"], len(ranks)).astype(np.int64), ranks


def _place_ranks(offsets: np.ndarray):
    """All ranks of a home in one row, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, home = [], -1
        for row in _rows(batches):
            home = row["bucket"]
            at, r = _placed(row)
            parts.append((at, r + np.uint64(offsets[row["source"]])))
        if home < 0:
            return
        at, r = (np.concatenate(x) for x in zip(*parts))
        out = np.empty(len(r), np.uint64)
        out[at] = r
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([home], pa.int32()), "symbols": [packed(out)], "aux": [b""]})

    return run, REGIONS


def _found(edges: list[tuple[int, int]], min_words: int):
    """Spans of a home's records from the places found in it."""
    kept = set(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aux, parts = b"", [np.zeros(0, np.int64)]
        for row in _rows(batches):
            if row["source"] is None:
                aux = row["aux"]
            elif not row["edge"] or (row["source"], row["edge"]) in kept:
                parts.append(_placed(row)[0])
        if len(places := np.unique(np.concatenate(parts))):
            yield spans_at(places, aux, min_words)

    return run, RECORD_SPANS


def _as_ranks(texts: DataFrame) -> DataFrame:
    """A text of ranks in the columns of ranks, for _both."""
    return texts.select("bucket", F.lit(0).alias("source"), F.col("symbols").alias("ranks"))


def repeated_spans(text: DataFrame, min_words: int, n: int) -> DataFrame:
    """RECORD_SPANS of the passages of min_words words that occur twice in the region texts of n homes."""
    down = [text]
    while True:
        r = ranges_for(n, len(down) - 1)
        names = checkpointed(exchange(down[-1].mapInArrow(*_triples(_triple_borders(down[-1], r))), n=r).mapInArrow(joined(_name), _NAMES))
        up = checkpointed(_both(down[-1], names, n).mapInArrow(*_next_text(_offsets(names, r))))
        distinct = names.filter("repeats").isEmpty()
        forget(names)
        if distinct:
            break
        down.append(up)
    while True:
        lowest, r = len(down) == 1, ranges_for(n, len(down) - 1)
        items = _both(down[-1], _as_ranks(up), n).mapInArrow(*_merge_items(_merge_borders(down[-1], up, r), min_words, lowest, r))
        ranks = checkpointed(exchange(items, n=r).mapInArrow(*_merge(lowest, n)))
        forget(up)
        if lowest:
            return checkpointed(_both(text, ranks, n).mapInArrow(*_found(_over_borders(ranks), min_words)))
        up = checkpointed(exchange(ranks, n=n).mapInArrow(*_place_ranks(_offsets(ranks, r))))
        forget(ranks)
        forget(down.pop())


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, fingerprint: int = FINGERPRINT) -> DataFrame:
    """(doc_id, start_word, end_word) of the maximal parts of docs (doc_id, text) made of passages of min_words words that occur twice or more.

    Every such passage is found. Occurrences may be in one text or several and may overlap. Equal texts are occurrences of each other. Null and empty texts have none; rows
    of null doc_id aren't searched; a row repeated whole counts as an occurrence, reported once; an empty table has none; other columns are ignored.
    """
    if min_words <= fingerprint:
        raise ValueError("min_words must exceed the fingerprint")
    n = homes_for(buckets(docs.sparkSession))
    rows = rows_of(docs)
    homes = homes_of(rows, min_words, n)
    known = known_rows(rows, homes)
    replies = shared_keys(homes, lambda row: _anchors(row, min_words, fingerprint)[1], n)

    def regions(row: dict, answers: dict[int, bytes]) -> np.ndarray:
        at, key = _anchors(row, min_words, fingerprint)
        at = at[is_shared(key, answers, n)]
        return around(at, at + fingerprint, min_words)

    text = region_text(homes, replies, regions, min_words, n)
    forget(homes)
    return spread(repeated_spans(text, min_words, n), known, min_words)
