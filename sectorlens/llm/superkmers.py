"""Window runs over token sequences, shared by the two substring operators.

A window is `length` consecutive tokens. Its anchor is the `k`-gram in it with the
smallest hash, the leftmost among equals, so equal windows have equal anchors at
equal offsets. Consecutive windows with one anchor form a run: a path through the
De Bruijn graph whose edges are the windows. A run is named by its anchor `a` and
by the hash `c` of all its tokens with the anchor's place, so two equal runs have
equal windows, and two different runs share a window only if they share `a`.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 1 << 64)
#: Words kept with their hashes by each Python worker.
CACHE = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


_words = _Hashes()
_bytes = mix(np.arange(1, 257, dtype=U) * U(R))
_powers = [np.ones(1, U), np.ones(1, U)]


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), U, len(words))


def byte_values(data: bytes) -> np.ndarray:
    return _bytes[np.frombuffer(data, np.uint8)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((R, R_INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, m, d = len(x) - width + 1, x, 1
    while 2 * d <= width:
        m = np.minimum(m[:-d], m[d:])
        d *= 2
    return np.minimum(m[:n], m[width - d : width - d + n])


class Runs(NamedTuple):
    start: np.ndarray  # first window of each run
    count: np.ndarray  # windows in it
    anchor: np.ndarray  # hash of the anchor
    content: np.ndarray  # hash of all its tokens and the anchor's place


class Windows:
    """Window and run hashes of one token sequence."""

    def __init__(self, values: np.ndarray, length: int, k: int):
        self.n, self.length, self.k = max(0, len(values) - length + 1), length, k
        self.values = values
        if self.n:
            p, self.back = powers(len(values) + 1)
            self.sums = np.zeros(len(values) + 1, U)
            np.cumsum(values * p[: len(values)], out=self.sums[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def places(self, g: np.ndarray) -> np.ndarray:
        """Where the anchor of each window is, given the hashes of all k-grams."""
        at = np.arange(len(g), dtype=U)
        return (sliding_min((g & U(0xFFFFFFFF00000000)) | at, self.length - self.k + 1) & U(0xFFFFFFFF)).astype(np.int64)

    def runs(self) -> Runs:
        if not self.n:
            e = np.empty(0, np.int64)
            return Runs(e, e, e, e)
        at = np.arange(len(self.values) - self.k + 1)
        g = self.span_hash(at, at + self.k)
        where = self.places(g)
        start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        count = np.diff(np.r_[start, self.n])
        place = where[start]
        return Runs(start, count, g[place].view(np.int64), self.contents(start, count, place))

    def contents(self, start: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix(self.span_hash(start, start + count + self.length - 1) ^ mix((place - start).astype(U) * U(256) + count.astype(U))).view(np.int64)

    def half_runs(self, inside: np.ndarray | None = None) -> Runs:
        """Runs (of the windows marked as inside) cut where windows change sides: those with at least half of their other tokens before the anchor, and the rest. The anchor grows by the tokens that all windows of a half have on that side."""
        if not self.n:
            return self.runs()
        at = np.arange(len(self.values) - self.k + 1)
        where = self.places(self.span_hash(at, at + self.k))
        before = (self.length - self.k + 1) // 2
        after = self.length - self.k - before + 1
        left = where - np.arange(self.n) >= before
        cut = (where[1:] != where[:-1]) | (left[1:] != left[:-1])
        start = np.flatnonzero(np.r_[True, cut if inside is None else cut | (inside[1:] != inside[:-1])])
        count = np.diff(np.r_[start, self.n])
        if inside is not None:
            start, count = start[inside[start]], count[inside[start]]
        place, left = where[start], left[start]
        anchor = self.span_hash(place - before * left, place + self.k + after * ~left)
        return Runs(start, count, anchor.view(np.int64), self.contents(start, count, place))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return self.span_hash(at, at + self.length).view(np.int64)


#: Tokens whose hashes are computed at once: few calls for short texts, arrays that stay in a core's cache.
CHUNK = 65_536


def chunks(texts: list, most: int = CHUNK) -> list[tuple[int, int]]:
    """Bounds of stretches of texts with about `most` tokens each."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i == len(texts) - 1:
            out.append((first, i + 1))
            first, size = i + 1, 0
    return out


def block_runs(values: list[np.ndarray], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of a block of texts, given their tokens' hashes: which text each half run is in, its first window, number of windows, anchor and content. No window crosses texts."""
    found = []
    for i, j in chunks(values):
        sizes = np.array([len(t) for t in values[i:j]], np.int64)
        w = Windows(np.concatenate(values[i:j]), length, k)
        if not w.n:
            continue
        base = np.cumsum(sizes) - sizes
        room = np.maximum(sizes - length + 1, 0)
        inside = np.zeros(w.n + 1, np.int64)
        np.add.at(inside, base[room > 0], 1)
        np.add.at(inside, (base + room)[room > 0], -1)
        r = w.half_runs(np.cumsum(inside[:-1]) > 0)
        doc = np.searchsorted(base, r.start, side="right") - 1
        found.append((doc + i, r.start - base[doc], r.count, r.anchor, r.content))
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n tokens some half-open span covers."""
    steps = np.zeros(n + 1, np.int64)
    if spans:
        s = np.asarray(spans, np.int64)
        np.add.at(steps, s[:, 0], 1)
        np.add.at(steps, s[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def row_key(df: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """Two longs that tell documents apart; rows equal in id and text share them."""
    integral = dict(df.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint")
    first = F.col(doc_id).cast("long") if integral else F.xxhash64(doc_id)
    return F.coalesce(first, F.lit(-(2**63))), F.xxhash64(F.col(text), F.col(doc_id).isNull())


Tokens = Callable[[str], np.ndarray]
