"""Main-text extraction: flat text blocks, classified by a decision tree on word counts and link densities of neighbours.

A page is cut at block-level tags into a flat list of text blocks. Each block is described by its words, its link density (words
within links over words) and those of the blocks before and after it. A CART tree (Gini impurity), trained here
on the small labelled table `LABELLED`, tells main text from boilerplate; a page's main text is its accepted blocks in order.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")
PAGES = "page_id bigint, url string, n_blocks int, n_main int, main_words int, main_text string"
# Every pattern that begins at "<" takes what it reads, to the end of the page if need be, so that no character is read again from the next "<".
_UNREAD = re.compile(r"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)(?=[\s/>])[^>]*+(?:>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)|<!doctype[^<>]*+>?")
_SKIPPED = re.compile(r"(?i)<(/?)(noscript|template|textarea|select|svg)(?=[\s/>])[^>]*+(?:>|\Z)")
_HEAD = re.compile(r"(?i)<head(?=[\s/>])[^>]*+(?:>|\Z)")
_IN_HEAD = re.compile(r"(?is)\s+|<title(?=[\s/>])[^>]*>(?:(?!</?title[\s/>]).)*</title\s*>|</?(?:title|meta|link|base|basefont|bgsound|noscript|template)(?=[\s/>])[^>]*>|<[!?][^>]*>")
_HEAD_END = re.compile(r"(?i)</head(?=[\s/>])[^>]*>")
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)(?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(>|\Z)""")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())

#: words, link density, words before, links before, words after, links after, main text or not: read off pages of news, weblogs, shops,
#: manuals and forums.
LABELLED = """
1 1 0 0 1 1 0|1 1 1 1 1 1 0|2 1 1 1 1 1 0|1 1 2 1 8 0 0|3 1 2 1 2 1 0|2 1 3 1 0 0 0|1 1 1 1 60 0 0|1 1 1 1 12 0 0
4 1 5 1 4 1 0|5 1 4 1 6 1 0|6 0.8 5 1 3 1 0|8 0.9 6 1 7 0.9 0|12 0.7 8 0.9 10 0.8 0|15 0.6 12 0.7 9 0.9 0|7 0.5 9 0.9 4 1 0
8 0 1 1 10 0 0|6 0 1 1 9 0 0|9 0 2 1 12 0 0|7 0 1 1 11 0 0|5 0 1 1 12 0 0|11 0 1 1 12 0 0|4 0 1 1 8 0 0|10 0 1 1 7 0 0
12 0 8 0 60 0 1|10 0 6 0 45 0 1|12 0 9 0 33 0 1|9 0 7 0 80 0 1|8 0 5 0 25 0 1|11 0 11 0 110 0 1|7 0 10 0 50 0 1|12 0 4 0 14 0 1
12 0 7 0 6 0 1|9 0 8 0 4 0 1|12 0 10 0 2 0 1|6 0 9 0 18 0 1|12 0 5 0 9 0 1
60 0 12 0 70 0 1|45 0 10 0 30 0 1|33 0.05 12 0 20 0 1|80 0 9 0 60 0 1|25 0.1 8 0 40 0 1|110 0 11 0 90 0 1|50 0 60 0 12 0 1
70 0 60 0 55 0 1|30 0.1 45 0 3 0 1|20 0 33 0 5 0 1|60 0 80 0 4 0 1|40 0.2 25 0 9 0.9 1|90 0 110 0 2 0 1|14 0 50 0 70 0 1
3 0 70 0 55 0 1|2 0 30 0 44 0 1|5 0 20 0 61 0 1|1 0 60 0 33 0 1|4 0 40 0 28 0 1|2 0 90 0 4 0 1|1 0 2 0 30 0 1|3 0 14 0 2 0 1
2 0 3 0 1 0 1|1 0 1 0 1 0 1|1 0 1 0 40 0 1|4 0 5 0 7 0 1|6 0 12 0 12 0 1|2 0 12 0 10 0 1|3 0 10 0 8 0 1|5 0 6 0 9 0 1|8 0 12 0 12 0 1
10 0 70 0 0 0 0|8 0 55 0 0 0 0|12 0 30 0 0 0 0|9 0 3 0 0 0 0|7 0 44 0 0 0 0|11 0 12 0 0 0 0|6 0 90 0 0 0 0|13 0 5 0 0 0 0|14 0 20 0 0 0 0
5 0 28 0 0 0 0|3 0 60 0 0 0 0|10 0 1 0 0 0 0|12 0 2 0 0 0 0|8 0 4 0 0 0 0|16 0 40 0 0 0 0|9 0 8 0 0 0 0|12 0 100 0 0 0 0
200 0 12 0 10 0 1|150 0 40 0 8 0 1|100 0 0 0 0 0 1|40 0 0 0 60 0 1|60 0 3 1 80 0 1|35 0 2 1 50 0 1|80 0 1 1 0 0 1|50 0 0 0 0 0 1
30 0.9 40 0 20 0 0|18 0.8 60 0 30 0 0|25 0.7 10 0.9 12 1 0|9 1 80 0 50 0 0|4 1 60 0 70 0 0|2 1 90 0 3 1 0|3 1 45 0 0 0 0
""".strip()  # fmt: skip


@dataclass
class Node:
    main: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """CART: splits of least weighted Gini impurity, ties to the first feature and lowest cut, until pure, too deep or too few."""
    node = Node(bool(y.mean() >= 0.5) if len(y) else False)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return node
    best = (np.inf, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        left, right = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        impurity = n * left * (1 - left) + (len(y) - n) * right * (1 - right)
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(np.argmin(impurity))
        if impurity[k] < best[0] - 1e-12:
            best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return node
    high = x[:, best[1]] > best[2]
    node.feature, node.cut = best[1], float(best[2])
    node.low, node.high = fit_tree(x[~high], y[~high], depth - 1, least), fit_tree(x[high], y[high], depth - 1, least)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.main)
    out = np.empty(len(x), bool)
    high = x[:, node.feature] > node.cut
    out[high], out[~high] = predict(node.high, x[high]), predict(node.low, x[~high])
    return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(v) for v in r.split()] for line in LABELLED.splitlines() for r in line.split("|")])
    return rows[:, :-1], rows[:, -1]


@lru_cache(maxsize=1)
def tree() -> Node:
    return fit_tree(*labelled_table())


def readable(page: str) -> str:
    """page without comments, scripts and styles (to their end or that of the page), its head and other elements that hold no text of the page.

    The head ends at its end tag or at the first thing that can't be in one, as either of its tags may be left out; an element
    without an end tag, or closed in its own tag, loses just the tag.
    """
    source = _UNREAD.sub(" ", page)
    opened: dict[str, list[int]] = {}
    cuts: list[tuple[int, int]] = []
    for m in _SKIPPED.finditer(source):
        starts = opened.setdefault(m[2].lower(), [])
        if m[1]:
            if starts:
                cuts.append((starts.pop(), m.end()))
        elif not m[0].endswith("/>"):
            starts.append(m.start())
    parts, at = [], 0
    for a, b in sorted(cuts):
        if a >= at:  # else within the cut before
            parts += [source[at:a], " "]
        at = max(at, b)
    source = "".join([*parts, source[at:]])
    if m := _HEAD.search(source):
        at = m.end()
        while inside := _IN_HEAD.match(source, at):
            at = inside.end()
        if end := _HEAD_END.match(source, at):
            at = end.end()
        source = f"{source[: m.start()]} {source[at:]}"
    return source


def blocks(page: str | None) -> list[tuple[str, int, int]]:
    """(text, words, words within links) of each non-empty block, in order; entities are resolved and white space is collapsed. What looks like a tag but is never closed is text."""
    source = readable(page or "")
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = at = depth = 0

    def close() -> None:
        nonlocal parts, linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), len(words), min(linked, len(words))))
        parts, linked = [], 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            plain = html.unescape(piece)
            parts.append(plain)
            if depth:
                linked += len(plain.split())

    for m in _TAG.finditer(source):
        if not m[3]:  # no tag: nothing closes it
            break
        text(source[at : m.start()])
        at = m.end()
        name = m[2].lower()
        if name == "a":
            depth = 0 if m[1] else 1
        elif name not in _INLINE:
            close()
            depth = 0
    text(source[at:])
    close()
    return out


def described(found: list[tuple[str, int, int]]) -> np.ndarray:
    """FEATURES of each block; beyond either end there are blocks without words."""
    words = np.array([0, *(b[1] for b in found), 0], float)
    links = np.array([0, *(b[2] for b in found), 0], float) / np.maximum(words, 1)
    return np.stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]], 1)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, n_blocks, n_main, main_words, main_text) for each row of pages (page_id, url, html).

    main_text joins the accepted blocks with line feeds. A null or empty html has no blocks and the text ''; null page_id and url
    stay null; repeated rows give repeated results; other columns are ignored.
    """
    classifier = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "html"):
            found = [blocks(h) for h in piece.column("html").to_pylist()]
            counts = [len(f) for f in found]
            x = np.concatenate([described(f) for f in found]) if sum(counts) else np.zeros((0, len(FEATURES)))
            main = predict(classifier, x)
            cols: list[list] = [[], [], []]
            at = 0
            for f, n in zip(found, counts):
                own = [b for b, ok in zip(f, main[at : at + n]) if ok]
                at += n
                for c, v in zip(cols, (len(own), sum(b[1] for b in own), "\n".join(b[0] for b in own))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(counts, pa.int32()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())],
                ["page_id", "url", "n_blocks", "n_main", "main_words", "main_text"],
            )

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, PAGES)
