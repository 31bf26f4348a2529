"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of its word n-grams (a text of fewer words is one gram). Documents of equal sets are one
*record*, named by a hash of the set; the join is between records, so copies cost no pairs. The global order of grams is by the number of
records that hold them, rarest first. It is cut into fragments; each fragment sees only its segment of every record, counts the overlap there of
the candidate pairs, and the partial counts are summed per pair. Grams are named by 56 bits.

1. Grams meet in buckets, which count records per gram. A gram of one record can't be shared: it only counts for sizes.
2. A record of which fewer than `threshold` of all grams are shared has no partner and leaves.
3. Two records at or above the threshold share one of the first n - ceil(threshold * n) + 1 grams of each. The
   fragments list such pairs, with the filters by length and by place: what follows the first shared gram must suffice for the
   threshold.
4. Fragments count the pairs' overlaps; sum and exact Jaccard test per pair.

Near copies of one text that all differ are pairs by their number squared, too many to be listed, sent and summed one by one. Records that are tied by such grams of
more than `_CROWD` records are a *crowd*, and the fragments leave out its pairs. A crowd is cut into blocks of records, and whoever has a pair of blocks counts all overlaps
between them from whole sets, tests them, and returns sums and ties; only `near_pairs` lists the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FLUSH, blob, bucket_of, buckets, by_key, checkpointed, column, exchange, only, packed, ranges, row_key, runs, split, unpacked
from .textkit import Words, chunks, mix, window_hashes, window_mask, words

NGRAM = 3
THRESHOLD = 0.5
LINKS = "doc_id bigint, class_id bigint, copy_of bigint, n_links bigint"
_SLACK = 1e-9
#: Records of a gram that one fragment lists pairs of; those of a gram of more are a crowd.
_CROWD = 1 << 8
#: Records, and grams, of a block of a crowd.
_BLOCK, _BLOCK_GRAMS = 1 << 11, 1 << 20
#: Partners of a record that go with its grams, about; those of one that has more are cut into parts.
_PARTNERS = 1 << 12


def ngram_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, gram) pairs, distinct, by owner and gram."""
    owner = w.owner
    grams = window_hashes(w.hashes, n)
    ok = window_mask(w.bounds, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    extra = [mix(w.hashes[w.bounds[k] : w.bounds[k + 1]] * np.arange(3, 3 + 2 * w.counts[k], 2, dtype=np.uint64)).sum(dtype=np.uint64) for k in short]
    owners = np.r_[owner[: len(grams)][ok], short].astype(np.int64)
    grams = np.r_[grams[ok], np.array(extra, np.uint64)]
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(owners[order], kind="stable")]
    owners, grams = owners[order], grams[order]
    if len(grams):
        fresh = np.r_[True, (owners[1:] != owners[:-1]) | (grams[1:] != grams[:-1])]
        owners, grams = owners[fresh], grams[fresh]
    return owners, grams


def _named(grams: np.ndarray) -> bytes:
    return packed(grams >> np.uint64(8))


def _grams(data: bytes) -> np.ndarray:
    return unpacked(data) << np.uint64(8)


_META = np.dtype([("record", np.int64), ("size", np.int64), ("null", np.int64), ("doc", np.int64), ("a", np.int64), ("b", np.int64)])
_PACKED = "bucket int, records binary, counts binary, grams binary, sizes binary, meta binary"


def _row(bucket: int, **columns: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), **{k: pa.array([columns.get(k, b"")], pa.binary()) for k in ("records", "counts", "grams", "sizes", "meta")}})


def _pack(n_gram: int, n: int):
    """Grams of the records of a task, each record once, in buckets of grams; sizes in buckets of records; meta of every row, in any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        meta: list[np.ndarray] = []
        met = np.zeros(0, np.uint64)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            records, grams = (np.concatenate(x) for x in zip(*held))
            for b, (r, g) in split(bucket_of(grams, n), n, records, grams):
                starts, lengths = runs(r)
                yield _row(b, records=blob(r[starts]), counts=packed(lengths), grams=_named(g))
            starts, lengths = runs(records)
            for b, (r, k) in split(bucket_of(records[starts], n), n, records[starts], lengths):
                yield _row(b, sizes=blob(np.stack([r, k.astype(np.uint64)], 1)))
            m = np.concatenate(meta)
            for b, (x,) in split(bucket_of(m["a"].view(np.uint64), n), n, m):
                yield _row(b, meta=blob(x))

        for piece in chunks(batches):
            owners, grams = ngram_sets(words(piece.column("text")), n_gram)
            if not len(grams):
                continue
            grams = grams >> np.uint64(8) << np.uint64(8)
            starts, lengths = runs(owners)
            record = mix(np.add.reduceat(mix(grams), starts) + lengths.astype(np.uint64))
            ids = piece.column("doc_id").take(pa.array(owners[starts]))
            m = np.zeros(len(record), _META)
            m["record"], m["size"], m["null"], m["doc"] = record.view(np.int64), lengths, ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            m["a"], m["b"] = (piece.column(c).to_numpy()[owners[starts]] for c in ("a", "b"))
            meta.append(m)
            names, first = np.unique(record, return_index=True)
            first = first[~np.isin(names, met)]
            met = np.union1d(met, names)
            take = ranges(starts[first], lengths[first])
            held.append((np.repeat(record[first], lengths[first]), grams[take]))
            size += len(take)
            if size >= FLUSH:
                yield from flush()
                held, meta, size = [], [], 0
        if meta:
            yield from flush()

    return run, _PACKED


def _shared(n: int):
    """Of a bucket's grams those of two records or more, with how many, sent to the buckets of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, grams, bucket = [], [], -1
        for batch in batches:
            for k in range(batch.num_rows):
                bucket = batch.column("bucket")[k].as_py()
                get = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                if get("grams"):
                    records.append(np.repeat(np.frombuffer(get("records"), np.uint64), unpacked(get("counts")).astype(np.int64)))
                    grams.append(_grams(get("grams")))
                else:
                    yield _row(bucket, sizes=get("sizes"), meta=get("meta"))
        if not grams:
            return
        r, g = np.concatenate(records), np.concatenate(grams)
        del records, grams
        order = np.argsort(g, kind="stable")
        r, g = r[order], g[order]
        starts, lengths = runs(g)
        again = np.repeat(lengths > 1, lengths)  # a gram met once is one record's
        r, g = r[again], g[again]
        order = np.lexsort((r, g))
        r, g = r[order], g[order]
        if len(g):
            fresh = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
            r, g = r[fresh], g[fresh]
        starts, lengths = runs(g)
        df = np.repeat(lengths, lengths)
        r, g, df = r[df > 1], g[df > 1], df[df > 1]
        for b, (x, y, z) in split(bucket_of(r, n), n, r, g, df):
            order = np.argsort(x, kind="stable")
            x, y, z = x[order], y[order], z[order]
            starts, lengths = runs(x)
            yield _row(b, records=blob(x[starts]), counts=packed(lengths), grams=_named(y), sizes=packed(z))

    return run, _PACKED


def _survivors(threshold: float):
    """Rows of documents (record, doc_id, a, b) and of records that may have a partner (record, size, grams, df), grams in global order."""
    schema = pa.schema([("record", pa.int64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("grams", pa.binary()), ("df", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, parts = [np.zeros((0, 2), np.uint64)], []
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()  # noqa: B023, E731
                if data := get("meta"):
                    m = np.frombuffer(data, _META)
                    none = pa.nulls(len(m), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(m["record"]), pa.array(m["size"]), pa.array(m["doc"], mask=m["null"] > 0), pa.array(m["a"]), pa.array(m["b"]), none, none], schema=schema)
                elif data := get("grams"):
                    parts.append((np.repeat(np.frombuffer(get("records"), np.uint64), unpacked(get("counts")).astype(np.int64)), _grams(data), unpacked(get("sizes"))))
                else:
                    sizes.append(np.frombuffer(get("sizes"), np.uint64).reshape(-1, 2))
        if not parts:
            return
        r, g, df = (np.concatenate(x) for x in zip(*parts))
        m = np.concatenate(sizes)
        names, first = np.unique(m[:, 0], return_index=True)
        of = m[first, 1].astype(np.int64)
        order = np.lexsort((g, df, r))
        r, g, df = r[order], g[order], df[order]
        starts, lengths = runs(r)
        size = of[np.searchsorted(names, r[starts])]
        none = pa.nulls(1, pa.int64())
        for k in np.flatnonzero(lengths >= np.ceil(threshold * size - _SLACK)):
            lo, hi = starts[k], starts[k] + lengths[k]
            yield pa.RecordBatch.from_arrays([pa.array(r[lo : lo + 1].view(np.int64)), pa.array(size[k : k + 1]), none, none, none, pa.array([_named(g[lo:hi])], pa.binary()), pa.array([packed(df[lo:hi])], pa.binary())], schema=schema)

    return run, "record bigint, size bigint, doc_id bigint, a bigint, b bigint, grams binary, df binary"


def _df_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, count = np.unique(np.concatenate([unpacked(x) for x in batch.column("df").to_pylist()] or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"df": pa.array(value, pa.int64()), "n": pa.array(count, pa.int64())})


def fragment_of(grams: np.ndarray, df: np.ndarray, levels: np.ndarray, counts: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each gram: its place in the global order (df, gram), of all places, cut in equal parts.

    levels are the distinct df, counts the weight of the grams at each; within a level the place is that of the gram's hash.
    """
    before = np.cumsum(counts) - counts
    at = np.searchsorted(levels, df)
    place = before[at] + counts[at] * (grams >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.minimum((place * (fragments / counts.sum())).astype(np.int64), fragments - 1)


def _prefix(g: np.ndarray, size: int, threshold: float) -> int:
    """How many of a record's shared grams, rarest first, a partner must share one of."""
    return max(0, size - int(np.ceil(threshold * size - _SLACK)) + 1 - (size - len(g)))


def _components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of u and v, rising, and of each the least that pairs (u[k], v[k]) lead to."""
    names, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return names, names[label]
        label = after


def _ties(threshold: float, most: int):
    """Grams of over `most` records that records have in their prefixes, each with one that it is tied to by the records of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            for size, grams, df in zip(*(batch.column(c).to_pylist() for c in ("size", "grams", "df"))):
                g = _grams(grams)
                hot = g[np.flatnonzero(unpacked(df)[: _prefix(g, size, threshold)] > most)].view(np.int64)
                if len(hot):
                    edges.append(np.stack([np.full(len(hot), hot[0]), hot], 1))
            if sum(map(len, edges)) > FLUSH:
                edges = [np.stack(_components(*np.concatenate(edges).T), 1)]
        names, least = _components(*np.concatenate(edges).T)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(least)], ["gram", "tied"])

    return run, "gram bigint, tied bigint"


class _Crowds:
    """The crowd of a record: the least of the grams that its first hot gram is tied to; 0 for none."""

    def __init__(self, grams: np.ndarray, least: np.ndarray, threshold: float, most: int):
        self.grams, self.least, self.threshold, self.most = grams, least, threshold, most

    def of(self, g: np.ndarray, df: np.ndarray, size: int) -> int:
        hot = np.flatnonzero(df[: _prefix(g, size, self.threshold)] > self.most)
        return int(self.least[np.searchsorted(self.grams, g[hot[:1]].view(np.int64)[0])]) if len(hot) else 0

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowd = [self.of(_grams(g), unpacked(df), size) for g, df, size in zip(*(batch.column(c).to_pylist() for c in ("grams", "df", "size")))]
            found = pa.RecordBatch.from_arrays([batch.column("record"), batch.column("size"), pa.array(crowd, pa.int64())], ["record", "size", "crowd"])
            yield found.filter(pa.array(np.array(crowd, np.int64) != 0))


def _prefixes(levels: np.ndarray, counts: np.ndarray, fragments: int, threshold: float, crowds: _Crowds | None = None):
    """Of every record the grams that a partner must share one of, each with the grams from it on, cut into fragments; without those that make crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            frag, docs, sizes, crowd, grams, rest = (np.concatenate(x) for x in zip(*held))
            for b, (d, s, c, g, m) in split(frag, fragments, docs, sizes, crowd, grams, rest):
                starts, lengths = runs(d)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "docs": [blob(d[starts])], "sizes": [packed(s[starts])], "crowds": [packed(c[starts].view(np.uint64))], "counts": [packed(lengths)], "grams": [_named(g)], "rest": [packed(m)]})

        for batch in batches:
            for k in range(batch.num_rows):
                g, df = _grams(batch.column("grams")[k].as_py()), unpacked(batch.column("df")[k].as_py())
                doc, size = batch.column("record")[k].as_py(), batch.column("size")[k].as_py()
                crowd = crowds.of(g, df, size) if crowds else 0
                rest = np.arange(len(g), 0, -1)
                cut = _prefix(g, size, threshold)
                g, df, rest = g[:cut], df[:cut], rest[:cut]
                if crowd:
                    g, df, rest = (x[df <= crowds.most] for x in (g, df, rest))
                if not len(g):
                    continue
                held.append((fragment_of(g, df, levels, counts, fragments), np.full(len(g), doc), np.full(len(g), size, np.int64), np.full(len(g), crowd, np.int64), g, rest))
                total += len(g)
                if total >= FLUSH:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    return run, "bucket int, docs binary, sizes binary, crowds binary, counts binary, grams binary, rest binary"


def _fragment(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    parts = []
    for batch in batches:
        for docs, sizes, crowds, counts, grams, rest in zip(*(batch.column(c).to_pylist() for c in ("docs", "sizes", "crowds", "counts", "grams", "rest"))):
            n = unpacked(counts).astype(np.int64)
            parts.append((np.repeat(np.frombuffer(docs, np.int64), n), np.repeat(unpacked(sizes).astype(np.int64), n), np.repeat(unpacked(crowds), n), _grams(grams), unpacked(rest).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5


#: Posting lists up to this length are expanded many at a time.
_SHORT = 48


class _PairSet:
    """Distinct pairs of numbers below n, in bounded memory: where there are very many, they are given out in parts, which may have pairs in common."""

    def __init__(self, n: int):
        self.n, self.parts, self.size, self.limit = n, [], 0, 2 << 20

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append(a * self.n + b)
        self.size += len(a)

    def full(self) -> bool:
        """Whether a part is to be taken now."""
        if self.size > self.limit:
            self.parts = [np.unique(np.concatenate(self.parts))]
            self.size, self.limit = len(self.parts[0]), max(2 << 20, 2 * len(self.parts[0]))
        return self.size > 4 << 20

    def values(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int64)
        self.parts, self.size, self.limit = [], 0, 2 << 20
        return out


def _candidates(threshold: float):
    """Distinct pairs (a < b) that share a prefix gram in this fragment and whose sizes, and grams from that one on, allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, s, crowd, g, rest = _fragment(batches)
        if not len(d):
            return
        ids, first = np.unique(d, return_index=True)
        by_size = np.lexsort((ids, s[first]))  # records are numbered by size, so partners of fitting size are a range of a posting list
        ids, sizes, crowd = ids[by_size], s[first][by_size], crowd[first][by_size]
        number = np.empty(len(ids), np.int64)
        number[by_size] = np.arange(len(ids))
        x = number[np.searchsorted(np.sort(ids), d)]
        order = np.lexsort((x, g))
        x, g, rest = x[order], g[order], rest[order]
        starts, lengths = runs(g)
        found = _PairSet(len(ids))

        def add(a: np.ndarray, b: np.ndarray, rest_a: np.ndarray, rest_b: np.ndarray) -> None:
            ok = (sizes[a] >= threshold * sizes[b] - _SLACK) & (np.minimum(rest_a, rest_b) * (1 + threshold) >= threshold * (sizes[a] + sizes[b]) - _SLACK)
            ok &= (crowd[a] != crowd[b]) | (crowd[a] == 0)
            found.add(a[ok], b[ok])

        def taken() -> Iterator[pa.RecordBatch]:
            pairs = found.values()
            a, b = ids[pairs // len(ids)], ids[pairs % len(ids)]
            for at in range(0, len(pairs), 1 << 16):
                p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["doc_a", "doc_b"])

        for n in np.unique(lengths[(lengths > 1) & (lengths <= _SHORT)]):
            at = starts[lengths == n]
            i, j = np.triu_indices(n, 1)
            step = max(1, (1 << 20) // len(i))
            for lo in range(0, len(at), step):
                place = at[lo : lo + step, None] + np.arange(n)
                posting, left = x[place], rest[place]
                add(posting[:, i].ravel(), posting[:, j].ravel(), left[:, i].ravel(), left[:, j].ravel())
                if found.full():
                    yield from taken()
        lists: dict[bytes, np.ndarray] = {}
        for lo, n in zip(starts[lengths > _SHORT], lengths[lengths > _SHORT]):  # grams of the same records list the same pairs, the first of them the most
            key = x[lo : lo + n].tobytes()
            have = lists.get(key)
            lists[key] = rest[lo : lo + n] if have is None else np.maximum(have, rest[lo : lo + n])
        for key, left in lists.items():
            posting = np.frombuffer(key, np.int64)
            n = len(posting)
            more = np.searchsorted(sizes[posting], sizes[posting] / threshold + _SLACK, "right") - np.arange(1, n + 1)
            ends = np.cumsum(more)
            lo_i = 0
            while lo_i < n:
                hi_i = max(lo_i + 1, int(np.searchsorted(ends, (ends[lo_i - 1] if lo_i else 0) + (2 << 20), "right")))
                i = np.arange(lo_i, min(hi_i, n))
                j, i = ranges(i + 1, more[i]), np.repeat(i, more[i])
                add(posting[i], posting[j], left[i], left[j])
                lo_i = hi_i
                if found.full():
                    yield from taken()
        yield from taken()

    return run, "doc_a bigint, doc_b bigint"


def _with_partners(levels: np.ndarray, counts: np.ndarray, fragments: int):
    """Segments of records that are in a candidate pair; each carries the record's partners of greater name, or a part of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                g, df = _grams(row.column("grams")[0].as_py()), unpacked(row.column("df")[0].as_py())
                partners = row.column("partners")[0].values
                b = blob(np.sort(partners.to_numpy())) if partners is not None and len(partners) else b""
                out = list(split(fragment_of(g, df, levels, counts, fragments), fragments, g))
                n = len(out)
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([f for f, _ in out], pa.int32()), "doc": pa.array([row.column("record")[0].as_py()] * n, pa.int64()), "grams": [_named(x) for _, (x,) in out], "partners": [b] * n}
                )

    return run, "bucket int, doc bigint, grams binary, partners binary"


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, grams, partners = [], [], []
    for batch in batches:
        docs += batch.column("doc").to_pylist()
        grams += [_grams(x) for x in batch.column("grams").to_pylist()]
        partners += [np.frombuffer(x, np.int64) for x in batch.column("partners").to_pylist()]
    if not docs:
        return
    ids = np.array(docs)
    order = np.argsort(ids)
    ids = ids[order]
    lengths = np.array([len(grams[k]) for k in order])
    starts = np.cumsum(lengths) - lengths
    _, codes = np.unique(np.concatenate([grams[k] for k in order]), return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1, np.uint8)
    a_out, b_out, n_out = [], [], []
    held = 0
    for i, k in enumerate(order):
        b = partners[k]
        at = np.searchsorted(ids, b)
        ok = at < len(ids)
        ok[ok] = ids[at[ok]] == b[ok]
        at = at[ok]
        if not len(at):
            continue
        own = codes[starts[i] : starts[i] + lengths[i]]
        mark[own] = 1
        n = np.add.reduceat(mark[codes[ranges(starts[at], lengths[at])]], np.cumsum(lengths[at]) - lengths[at], dtype=np.int64)
        mark[own] = 0
        some = n > 0
        a_out.append(np.full(int(some.sum()), ids[i]))
        b_out.append(ids[at[some]])
        n_out.append(n[some])
        held += len(a_out[-1])
        if held > 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, n_out)], ["doc_a", "doc_b", "overlap"])
            a_out, b_out, n_out, held = [], [], [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a_out, b_out, n_out)], ["doc_a", "doc_b", "overlap"])


#: Grams of a pair of blocks that are held by so many of its records or more are counted by products of matrices, so many at a time.
_DENSE, _COLUMNS = 32, 1 << 10


def block_overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Of each set of a and each of b (None: a again) the number of grams that both have."""
    sides = [a] if b is None else [a, b]
    sizes = [np.array([len(x) for x in side]) for side in sides]
    _, code, count = np.unique(np.concatenate([x for side in sides for x in side]), return_inverse=True, return_counts=True)
    owner = [np.repeat(np.arange(len(n)), n) for n in sizes]
    codes = [code] if b is None else [code[: len(owner[0])], code[len(owner[0]) :]]
    na, nb = len(a), len(sides[-1])
    out = np.zeros(na * nb, np.float32)
    # rare ones: of each in a those in b
    rare_a, rare_b = (np.flatnonzero((count[c] > 1) & (count[c] < _DENSE)) for c in (codes[0], codes[-1]))
    rare_b = rare_b[np.argsort(codes[-1][rare_b], kind="stable")]
    sorted_b = codes[-1][rare_b]
    lo, hi = (np.searchsorted(sorted_b, codes[0][rare_a], side) for side in ("left", "right"))
    step = (1 << 20) // _DENSE
    for k in range(0, len(rare_a), step):
        n = (hi - lo)[k : k + step]
        at = np.repeat(owner[0][rare_a[k : k + step]], n) * nb + owner[-1][rare_b[ranges(lo[k : k + step], n)]]
        cell, times = np.unique(at, return_counts=True)
        out[cell] += times
    out = out.reshape(na, nb)
    number = np.full(len(count), -1)
    dense = np.flatnonzero(count >= _DENSE)
    number[dense] = np.arange(len(dense))
    columns = [number[c] for c in codes]
    for k in range(0, len(dense), _COLUMNS):
        parts = []
        for col, own, n in zip(columns, owner, sizes):
            m = np.zeros((len(n), min(_COLUMNS, len(dense) - k)), np.float32)
            mine = np.flatnonzero((col >= k) & (col < k + _COLUMNS))
            m[own[mine], col[mine] - k] = 1
            parts.append(m)
        out += parts[0] @ parts[-1].T
    return out


def _spanning(ok: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A row, and the rows and columns that it is connected with, for each part of the graph of the true cells."""
    todo, met = ok.any(1), np.zeros(ok.shape[1], bool)
    for k in np.flatnonzero(todo):
        if not todo[k]:
            continue
        rows, own_rows, own_columns = np.array([k]), [], []
        while len(rows):
            todo[rows] = False
            columns = np.flatnonzero(ok[rows].any(0) & ~met)
            met[columns] = True
            own_rows.append(rows)
            own_columns.append(columns)
            rows = np.flatnonzero(ok[:, columns].any(1) & todo)
        yield k, np.concatenate(own_rows), np.concatenate(own_columns)


def _crowd(threshold: float, listed: bool):
    """Of each pair of blocks the pairs of records at or above the threshold; if they aren't listed, of each record the weight of its partners, and pairs that connect what they connect."""
    schema = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64()), ("overlap", pa.int64()), ("jaccard", pa.float64()), ("near", pa.int64())])

    def batch(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns["doc_a"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def judged(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        same = rows[0]["i"] == rows[0]["j"]
        sides = [[r for r in rows if r["block"] == k] for k in ((rows[0]["i"],) if same else (rows[0]["i"], rows[0]["j"]))]
        if not all(sides):
            return
        overlap = block_overlaps(*([_grams(r["grams"]) for r in side] for side in sides), *([None] * same))
        of = lambda c, k: np.array([r[c] for r in sides[k]], np.int64)
        a, b, size_a, size_b = of("record", 0), of("record", -1), of("size", 0), of("size", -1)
        ok = np.empty(overlap.shape, bool)
        for k in range(len(a)):
            ok[k] = overlap[k] / (size_a[k] + size_b - overlap[k].astype(np.float64)) >= threshold - _SLACK
        if same:
            np.fill_diagonal(ok, False)
        if not listed:
            for record, near in ((a, ok @ of("weight", -1)), *(() if same else ((b, ok.T @ of("weight", 0)),))):
                yield batch(doc_a=record[near > 0], near=near[near > 0])
            for k, x, y in _spanning(ok):
                other = np.r_[a[x], b[y]]
                yield batch(doc_a=np.minimum(a[k], other), doc_b=np.maximum(a[k], other))
            return
        for k in range(len(a)):
            at = np.flatnonzero(ok[k, k + 1 :]) + k + 1 if same else np.flatnonzero(ok[k])
            if len(at):
                n = overlap[k, at].astype(np.int64)
                yield batch(doc_a=np.minimum(a[k], b[at]), doc_b=np.maximum(a[k], b[at]), overlap=n, jaccard=n / (size_a[k] + size_b[at] - n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in batches:
            for at in range(0, part.num_rows, 256):
                for row in part.slice(at, 256).to_pylist():
                    if held and any(row[c] != held[0][c] for c in ("crowd", "i", "j")):
                        yield from judged(held)
                        held = []
                    held.append(row)
        if held:
            yield from judged(held)

    return run, "doc_a bigint, doc_b bigint, overlap bigint, jaccard double, near bigint"


def _crowded(several: DataFrame, members: DataFrame, crowds: _Crowds, threshold: float, listed: bool) -> DataFrame:
    """What _crowd gives for all pairs of blocks of all crowds. A block has records of about one size, and pairs of blocks whose sizes rule out the threshold aren't made."""
    found = several.select("record", "size", "grams", "df").mapInArrow(crowds.rows, "record bigint, size bigint, crowd bigint")
    before = Window.partitionBy("crowd").orderBy("size", "record").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(1 / _BLOCK), F.col("size") / _BLOCK_GRAMS)
    placed = checkpointed(found.withColumn("block", F.floor(F.coalesce(F.sum(room).over(before), F.lit(0.0)) + _SLACK).cast("bigint")))
    blocks = placed.groupBy("crowd", "block").agg(F.count("*").alias("n"), F.min("size").alias("low"), F.max("size").alias("high"))
    two = blocks.select("crowd", F.col("block").alias("i"), F.col("high").alias("most")).join(blocks.select("crowd", F.col("block").alias("j"), "n", "low"), "crowd")
    two = two.filter(((F.col("i") < F.col("j")) & (F.col("most") >= threshold * F.col("low") - _SLACK)) | ((F.col("i") == F.col("j")) & (F.col("n") > 1)))
    sides = two.select("crowd", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    weights = members.filter("doc_id is not null").select("record", "doc_id").distinct().groupBy("record").agg(F.count("*").alias("weight"))
    whole = several.select("record", "grams").join(placed, "record").join(weights, "record", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    sent = whole.join(sides, ["crowd", "block"]).repartition(buckets(several.sparkSession), "crowd", "i", "j").sortWithinPartitions("crowd", "i", "j")
    return checkpointed(sent.select("crowd", "i", "j", "block", "record", "size", "weight", "grams").mapInArrow(*_crowd(threshold, listed)))


def _joined(docs: DataFrame, n: int, threshold: float, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record, size, doc_id, a, b) of each row of docs with words, named by a and b; (doc_a, doc_b, overlap, jaccard) of the pairs of records that are in no crowd together; what _crowd gives for the others."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    p = buckets(spark)
    key = row_key(docs)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), key["a"].alias("a"), key["b"].alias("b"))
    shared = exchange(rows.mapInArrow(*_pack(n, p))).mapInArrow(*_shared(p))
    records = checkpointed(exchange(shared).mapInArrow(*_survivors(threshold)))
    members = records.filter("grams is null").select("record", "size", "doc_id", "a", "b")
    several = records.filter("grams is not null").select("record", "size", "grams", "df")
    levels = several.select("df").mapInArrow(_df_counts, "df bigint, n bigint").groupBy("df").agg(F.sum("n").alias("n")).orderBy("df").collect()  # at most one row per distinct count
    if not levels:
        return members, spark.createDataFrame([], "doc_a bigint, doc_b bigint, overlap bigint, jaccard double"), spark.createDataFrame([], _crowd(threshold, listed)[1])
    df = np.array([r[0] for r in levels], np.uint64)
    n_grams, work = np.array([r[1] for r in levels], np.float64), np.array([r[1] * r[0] for r in levels], np.float64)  # a gram's work grows with the square of its records
    counts = work / work.sum() + n_grams / n_grams.sum()  # no fragment gets over twice its share of either the work or the grams
    crowds, crowd = None, spark.createDataFrame([], _crowd(threshold, listed)[1])
    if df[-1] > _CROWD:
        ties = np.array([tuple(r) for r in several.select("size", "grams", "df").mapInArrow(*_ties(threshold, _CROWD)).distinct().collect()], np.int64).reshape(-1, 2)  # only of grams of over _CROWD records
        if len(ties):
            crowds = _Crowds(*_components(*ties.T), threshold, _CROWD)
            crowd = _crowded(several, members, crowds, threshold, listed)
    candidates = checkpointed(exchange(several.mapInArrow(*_prefixes(df, counts, p, threshold, crowds))).mapInArrow(*_candidates(threshold)).distinct())
    many = candidates.groupBy("doc_a").agg(F.count("*").alias("n")).filter(F.col("n") > _PARTNERS)
    part = F.pmod(F.xxhash64("doc_b"), F.ceil(F.coalesce("n", F.lit(1)) / _PARTNERS))  # 0 but for records of many partners
    partners = candidates.join(many, "doc_a", "left").groupBy(F.col("doc_a").alias("record"), part.alias("part")).agg(F.collect_list("doc_b").alias("partners")).drop("part")
    inside = candidates.select(F.explode(F.array("doc_a", "doc_b")).alias("record")).distinct()
    paired = several.join(inside, "record", "left_semi").join(partners, "record", "left")
    partial = exchange(paired.mapInArrow(*_with_partners(df, counts, p))).mapInArrow(_overlaps, "doc_a bigint, doc_b bigint, overlap bigint")
    sizes = several.select(F.col("record").alias("doc"), "size")
    near = (
        partial.groupBy("doc_a", "doc_b").agg(F.sum("overlap").alias("overlap"))
        .join(sizes.toDF("doc_a", "size_a"), "doc_a").join(sizes.toDF("doc_b", "size_b"), "doc_b")
        .withColumn("jaccard", F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap")))
        .filter(F.col("jaccard") >= threshold - _SLACK)
        .select("doc_a", "doc_b", "overlap", "jaccard")
    )
    return members, checkpointed(near), crowd


def near_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_a, doc_b, overlap, jaccard) between the least doc_ids of different sets of word n-grams with Jaccard >= threshold, doc_a < doc_b.

    Rows of docs (doc_id, text) with equal sets are one set. Rows of null doc_id name no set; null, empty or
    blank texts are in no pair; a doc_id with several texts stands for each of them; an empty table gives no pairs; other columns don't matter.
    """
    members, near, crowd = _joined(docs, n, threshold, True)
    near = near.unionByName(crowd.drop("near"))
    least = members.groupBy("record").agg(F.min("doc_id").alias("least")).dropna()
    named = near.join(least.toDF("doc_a", "a"), "doc_a").join(least.toDF("doc_b", "b"), "doc_b")
    return named.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "overlap", "jaccard")


def _all_ties(near: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs that connect all records that are connected."""
    return near.select("doc_a", "doc_b").unionByName(crowd.filter("near is null").select("doc_a", "doc_b"))


def links(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of each document (doc_id, text) whose set of word n-grams has Jaccard >= threshold with that of another.

    n_links counts the other documents with such a set, copies included. copy_of is the least doc_id of those with an equal set, class_id the
    least of all that are connected by links. Every pair of different sets is found and counted; copies aren't expanded into pairs. A document is a doc_id and a
    set: rows repeated with the same doc_id are one, a doc_id with two different texts has a row for each. Rows of null doc_id and null, empty or
    blank texts have no links; an empty table gives no rows; other columns don't matter.
    """
    members, near, crowd = _joined(docs, n, threshold, False)
    named = members.select("record", "doc_id").filter("doc_id is not null").distinct()
    sets = named.groupBy("record").agg(F.count("*").alias("n"), F.min("doc_id").alias("copy_of"))
    both = near.select("doc_a", "doc_b").unionByName(near.select(F.col("doc_b").alias("doc_a"), F.col("doc_a").alias("doc_b")))
    weighed = both.join(sets.select(F.col("record").alias("doc_b"), "n"), "doc_b").select("doc_a", F.col("n").alias("near")).unionByName(crowd.filter("near is not null").select("doc_a", "near"))
    linked = weighed.groupBy(F.col("doc_a").alias("record")).agg(F.sum("near").alias("near"))
    sets = sets.join(linked, "record", "left").withColumn("n_links", F.col("n") - 1 + F.coalesce("near", F.lit(0))).filter("n_links > 0")
    sets = checkpointed(sets.join(groups(_all_ties(near, crowd)).withColumnRenamed("doc_id", "record"), "record", "left").withColumn("group_id", F.coalesce("group_id", "record")).select("record", "copy_of", "n_links", "group_id"))
    classes = sets.groupBy("group_id").agg(F.min("copy_of").alias("class_id"))
    return named.join(sets.join(classes, "group_id").drop("group_id"), "record").select("doc_id", "class_id", "copy_of", "n_links")


def groups(pairs: DataFrame) -> DataFrame:
    """(doc_id, group_id) for each document in a pair: group_id is the least doc_id of its connected group.

    Rounds of large-star and small-star (Kiveris and others, 2014), each a shuffle of the edges, until they no longer change.
    """
    edges = checkpointed(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpointed(small.filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionByName(roots)


def one_per_group(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each connected group of near duplicates, that of the least doc_id (null after all others), and all rows without words; all columns stay.

    Rows are judged apiece, whatever their doc_id: two different texts of one doc_id don't go together, and of rows repeated whole one
    stays. Null, empty and blank texts are no duplicates; an empty table stays empty; columns may have any names.
    """
    members, near, crowd = _joined(docs, n, threshold, False)
    grouped = members.join(groups(_all_ties(near, crowd)).withColumnRenamed("doc_id", "record"), "record", "left").select(F.coalesce("group_id", "record").alias("group_id"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b").alias("row"))
    rows = checkpointed(grouped.groupBy("group_id", "row").agg(F.count("*").alias("n")))
    stays = rows.groupBy("group_id").agg(F.min("row").alias("best"))
    judged = rows.join(stays, "group_id")
    repeated = checkpointed(judged.filter("row = best and n > 1").select("row.a", "row.b"))
    left = only(docs, judged.filter("row <> best").select("row.a", "row.b").unionByName(repeated))
    again = docs.filter(F.lit(False)) if repeated.isEmpty() else by_key(docs, repeated, "left_semi").dropDuplicates()
    return left.unionByName(again)
