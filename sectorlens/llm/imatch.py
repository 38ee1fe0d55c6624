"""Document fingerprints by I-Match.

The lexicon is the band of terms whose inverse document frequency lies between two
bounds, counted over all documents. A document's distinct terms of the band are
hashed as a set: once all of them, and once for each of a fixed family of randomised
lexicon subsets, the same for every document. The family has LEVELS densities, each a
quarter of the one before, with SUBSETS subsets at each. A text of few terms is told by
the dense ones, a long text by the thin ones, in which few of its terms are left.

The likeness of two fingerprints is the share of equal hashes among the subsets that
are not empty for both, taken over the densities at which subsets are thin for them (a
quarter of the subsets or more empty for one of the two): there the chance of equal
hashes comes close to the share of common terms.

The band's lower end is a share of the documents, so the lexicon has at most
(mean distinct terms) / `rarest` entries however many documents there are; it is
broadcast with that bound, which is checked.

Cases: a null text counts as empty; a text without a band term uses all its terms; a
text without words is fingerprinted as it is; null ids come after all others; rows
with equal ids are ordered by a hash of the text; the one row of a table follows itself;
an empty table gives an empty table; clashing column names are replaced; texts are
read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import trim
from .superkmers import U, mix

#: The idf band as document shares, and the family of subsets.
RAREST, COMMONEST, SUBSETS, LEVELS = 1 / 2000, 1 / 20, 16, 6
NONE = "----"
MOST = 1_000_000
#: Terms of a lexicon, 8 bytes each, that a worker is asked to hold at most; texts of 1,000 distinct terms on average reach 2 million.
MOST_TERMS = 20_000_000
_seeds = mix(np.arange(1, SUBSETS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_least = np.array([[1 << 64 - 2 * level] for level in range(1, LEVELS + 1)], dtype=U)
_find = re.compile(r"\w+").findall


def terms(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words."""
    words = set(_find(text.lower()))
    return np.sort(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words)))


def band(t: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return t
    at = np.minimum(np.searchsorted(lexicon, t), len(lexicon) - 1)
    found = t[lexicon[at] == t]
    return found if len(found) else t


def fingerprint(text: str, lexicon: np.ndarray) -> str:
    """The hash of all band terms and LEVELS groups of SUBSETS hashes of four digits, densest first."""
    t = terms(text)
    if not len(t):
        return "x:" + xxhash.xxh3_64_hexdigest(text.encode())
    t = band(t, lexicon)
    value = mix(t)
    h = mix(t[None, :] ^ _seeds[:, None])
    out = [f"{int(value.sum(dtype=U)):016x}"]
    for least in _least[:, 0]:
        inside = h < least
        count = inside.sum(axis=1)
        sums = mix((inside * value).sum(axis=1, dtype=U)) & U(0xFFFF)
        out.append("".join(f"{x:04x}" if n else NONE for x, n in zip(sums.tolist(), count.tolist(), strict=True)))
        if not count.any():  # thinner subsets of this text are empty too
            out += [NONE * SUBSETS] * (LEVELS + 1 - len(out))
            break
    return ":".join(out)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a.split(":"), b.split(":")
    if len(x) != LEVELS + 1 or len(y) != LEVELS + 1:
        return 0.0
    same = of = 0
    for p, q in zip(x[1:], y[1:], strict=True):
        if 4 * max(p.count(NONE), q.count(NONE)) < SUBSETS and p is not x[-1]:
            continue
        for i in range(0, 4 * SUBSETS, 4):
            u, v = p[i : i + 4], q[i : i + 4]
            if u != NONE or v != NONE:
                of += 1
                same += u == v
    return same / of if of else 0.0


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the idf band, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in (part for big in batches for part in slices(big, text)):
            for t in batch.column(0).to_pylist():
                held.append(terms(t or ""))
                size += len(held[-1])
                if size > 4 * MOST:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    total = docs.count()
    low = max(1, math.ceil(rarest * total))
    high = max(low, math.floor(commonest * total))
    counts = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n").between(low, high)).select("h").limit(MOST_TERMS + 1).toArrow().column("h").to_numpy()
    if len(found) > MOST_TERMS:  # nothing is left out: such texts need a narrower band
        raise ValueError(f"more than {MOST_TERMS} terms in the band; raise the least share of documents")
    return np.sort(found.view(np.uint64))


def fingerprints(docs: DataFrame, words: np.ndarray, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The columns of docs plus the fingerprint of each text."""
    rest = [f for f in docs.schema.fields if f.name.lower() != out.lower()]
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for big in batches for part in slices(big, text)):
            found = pa.array([fingerprint(t or "", sent.value) for t in batch.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), found], [*(f.name for f in rest), out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


def edited(own: str, following: str) -> str:
    """The last quarter of a text replaced by the beginning of the following one."""
    n = len(own) // 4
    return own[: len(own) - n] + following[:n]


def with_next(docs: DataFrame, words: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_chars, digest of its edited text, both fingerprints and the likenesses to the edited and the next text.

    Documents are dealt to ranges of ids; the first row of a range also goes to the
    range before it, so that each range is read in order with its successor at hand.
    """
    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.agg(F.min("o"), F.percentile_approx("o", [i / n for i in range(1, n)], 100 * n)).first()
    bounds = np.unique(np.array([x for x in (found[0], *(found[1] or ())) if x is not None], np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in (part for big in batches for part in slices(big, "text")):
            o = batch.column("o").to_numpy()
            part = np.searchsorted(bounds, o, side="right") - 1
            copies = np.flatnonzero(o == bounds[part])
            back = np.where(part[copies] == 0, len(bounds) - 1, part[copies] - 1)
            take = pa.array(np.r_[np.arange(len(o)), copies])
            data = pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
            columns = [pa.array(np.r_[part, back]), pa.array(np.r_[np.zeros(len(o), bool), np.ones(len(copies), bool)]), *(c.take(take) for c in (batch.column("doc_id"), batch.column("o"), batch.column("tie"), data))]
            yield pa.RecordBatch.from_arrays(columns, ["p", "extra", "doc_id", "o", "tie", "z"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        held = None  # the row that waits for its successor

        def row(after: tuple) -> tuple:
            _, doc, own, mine = held
            changed = edited(own, after[2])
            other = fingerprint(changed, sent.value)
            return doc, len(own), hashlib.sha256(changed.encode()).hexdigest(), mine, other, likeness(mine, other), likeness(mine, after[3])

        for batch in batches:
            out = []
            for p, extra, doc, data in zip(*(batch.column(c).to_pylist() for c in ("p", "extra", "doc_id", "z")), strict=True):
                if extra and (held is None or held[0] != p):
                    continue
                own = z.decompress(data).decode()
                now = (p, doc, own, fingerprint(own, sent.value))
                if held is not None and held[0] == p:
                    out.append(row(now))
                held = None if extra else now
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                trim()

    dealt = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(deal, "p long, extra boolean, doc_id long, o long, tie long, z binary")
    ordered = dealt.repartition(n, "p").sortWithinPartitions("p", "extra", "o", "tie")
    return ordered.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
