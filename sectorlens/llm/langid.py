"""Language identification with a bit-sliced Bloom filter over character n-grams.

Each cell of the filter is a bit mask with one bit per language. Adding an n-gram
of a language sets that language's bit in the n-gram's cells; looking one up ANDs
its cells and gives all languages that contain it at once. A text's n-grams are
counted per language (popcounts by bit), each count is corrected by the rate at
which that language's slice answers falsely, and the largest decides. The score
is the share of the text's n-grams that the language contains, so corrected.

The filter is learnt from at most `per_lang` labelled texts of each language (a
bound; the distinct texts with the smallest hashes, so copies count once) and holds
all their n-grams. It is put together by Spark: texts become cells with a mask, cells
are OR-ed, and 2^bits masks at most reach the driver, however much was read.

Cases: a null text, or one without a letter, is `und` with score 0; rows without a
label teach nothing; with no labelled row at all every text is `und`; equal shares,
also if all are 0, go to the first language in order; empty tables give empty tables; clashing column
names are replaced; texts are read whole, in blocks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import trim
from .superkmers import mix

UNKNOWN = "und"
N = 5
HASHES = 3
_fold: list[np.ndarray] = []


def fold() -> np.ndarray:
    """Per code point: the letter in lower case, or a space for what is no letter."""
    if not _fold:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if (x := chr(c)).isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text, with a space at either end; none if it has no letter. Windows of spaces only are left out."""
    codes = fold()[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = codes == 32
    if space.all():
        return np.empty(0, np.uint64)
    codes = codes[~(space & np.r_[False, space[:-1]])].astype(np.uint64)  # runs of spaces count as one
    n = min(N, len(codes))
    h = codes[: len(codes) - n + 1].copy()
    for j in range(1, n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j]
    return mix(h)


def cells(h: np.ndarray, size: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64) for j in range(HASHES)]


@dataclass
class BitSlicedFilter:
    """languages[i] owns bit i % 32 of word i // 32 of each cell; wrong[i] is the rate of false answers of its slice."""

    languages: list[str]
    masks: np.ndarray
    wrong: np.ndarray

    @classmethod
    def of(cls, languages: list[str], masks: np.ndarray) -> BitSlicedFilter:
        fill = np.array([(masks[i // 32] >> np.uint32(i % 32) & np.uint32(1)).mean() for i in range(len(languages))])
        return cls(languages, masks, fill**HASHES)

    def shares(self, h: np.ndarray) -> np.ndarray:
        """Per language the corrected share of the n-grams that it contains."""
        where, out = cells(h, self.masks.shape[1]), np.zeros(len(self.languages))
        for w, words in enumerate(self.masks):
            found = words[where[0]]
            for c in where[1:]:
                found = found & words[c]
            for i in range(32 * w, min(32 * w + 32, len(out))):
                out[i] = np.count_nonzero(found & np.uint32(1 << i % 32))
        out = (out / len(h) - self.wrong) / (1 - self.wrong)
        return np.clip(out, 0, 1)

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and number of n-grams."""
        h = grams(text) if text else []
        if not len(h) or not self.languages:
            return UNKNOWN, 0.0, len(h)
        shares = self.shares(h)
        best = int(shares.argmax())
        return self.languages[best], float(shares[best]), len(h)


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """At most per_lang distinct texts of each language (columns text, lang): those with the smallest hashes. Two passes over the labels and hashes."""
    hashed = rows.select("text", "lang", F.xxhash64("text").alias("h"))
    counts = {r.lang: r.n for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    under = lambda bounds: functools.reduce(operator.or_, ((F.col("lang") == name) & (F.col("h") <= h) for name, h in bounds.items()), F.lit(False))
    # a fifth more than wanted, for the error of the counts; then the exact bound
    wide = {name: min(2**63 - 1, int(1.2 * per_lang / n * 2**64) - 2**63) for name, n in counts.items()}
    found: dict[str, list[int]] = {}
    for r in hashed.where(under(wide)).select("lang", "h").distinct().collect():
        found.setdefault(r.lang, []).append(r.h)
    return hashed.where(under({name: sorted(h)[:per_lang][-1] for name, h in found.items()})).dropDuplicates(["lang", "h"]).select("text", "lang")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 1500, bits: int = 22) -> BitSlicedFilter:
    """Only rows with a text and a label teach, of those the sampled ones."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    languages = sorted(r.lang for r in rows.select("lang").distinct().collect())
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                found: dict[str, list[np.ndarray]] = {}
                for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    found.setdefault(name, []).append(np.unique(grams(t)))
                for name, arrays in found.items():
                    c = np.unique(np.concatenate(cells(np.concatenate(arrays), 1 << bits)))
                    i = number[name]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), i // 32, np.int32)), pa.array(c), pa.array(np.full(len(c), 1 << i % 32))], ["word", "cell", "mask"])

    masks = np.zeros((max(1, -(-len(languages) // 32)), 1 << bits if languages else 2), np.uint32)
    if languages:
        table = sample(rows, per_lang).mapInArrow(run, "word int, cell long, mask long").groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
        masks[table.column("word").to_numpy(), table.column("cell").to_numpy()] = table.column("mask").to_numpy().astype(np.uint32)
    return BitSlicedFilter.of(languages, masks)


def identify(docs: DataFrame, model: BitSlicedFilter, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep_text: bool = True, n_grams: str | None = None) -> DataFrame:
    """The columns of docs (on request without the text) plus the predicted language, its score and, if named, the number of n-grams that it rests on."""
    new = [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), *([T.StructField(n_grams, T.LongType())] if n_grams else [])]
    rest = [f for f in docs.schema.fields if f.name.lower() not in {x.name.lower() for x in new} and (keep_text or f.name != text)]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for big in batches:
            for batch in slices(big, text):
                found = [m.predict(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *([pa.array([x[2] for x in found], pa.int64())] if n_grams else [])], [*(f.name for f in rest), *(f.name for f in new)])
            trim()

    return docs.mapInArrow(run, T.StructType([*rest, *new]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
