"""Token counts by prefix dynamic programming.

For every prefix of a text the table holds the last token of its encoding and
the number of tokens. A prefix's last token is the one vocabulary token that ends
there and may stand after the last token of the prefix before it; two tokens may
stand side by side exactly if merging their joined text gives those two again.
Counts, truncation points and budgets are then look-ups, without re-encoding.

No token of the vocabulary holds a space after another character, so the table
falls into blocks (a run of spaces and what follows it, and likewise before a
mark that follows a letter in no token): within a block it is
filled by the recurrence, and between blocks counts add up. Blocks seen before
are taken from a cache of bounded size.

Cases: a null text counts as empty and has 0 tokens; empty tables give empty
tables; repeated rows each give a row; clashing column names are replaced;
texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import slices

CACHE = 600_000
SPACE = "▁"


class PrefixCounter:
    """Exact prefix counts for a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that leave texts as they are and add a leading space")
        self.scores = {p.piece: p.score for p in model.pieces if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece holds a space after another character")
        self.longest = max(map(len, self.scores))
        self.blocks = re.compile(self.pattern()).findall
        self.beside: dict[tuple[str, str], bool] = {}
        self.cache = Blocks(self)

    def pattern(self) -> str:
        """Where a text falls apart for certain: before a run of spaces, and between a letter and a mark that follows a letter in no piece."""
        follow = {b for p in self.scores for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        marks = "".join(re.escape(c) for c in ".,;:!?|)\n" if c not in follow)
        return (f"{SPACE}++[^\\W\\d_]++(?=[{marks}])|" if marks else "") + f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text: highest score first, leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two tokens stay side by side; an empty left is the start of a block."""
        known = self.beside.get((left, right))
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.beside) < CACHE:
                self.beside[left, right] = known
        return known

    def table(self, block: str) -> list[int]:
        """Numbers of tokens of all prefixes of a block, the empty one first."""
        scores, last, counts = self.scores, [""], [0]
        for end in range(1, len(block) + 1):
            for start in range(max(0, end - self.longest), end):
                token = block[start:end]
                if (token in scores or start == end - 1) and self.fits(last[start], token):
                    break
            last.append(token)
            counts.append(counts[start] + (1 if token in scores else len(token.encode())))
        return counts

    def split(self, text: str) -> list[str]:
        return self.blocks(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, text: str) -> int:
        return sum(map(self.cache.__getitem__, self.split(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        out, base = [np.zeros(1, np.int32)], 0
        for i, block in enumerate(self.split(text)):
            t = np.array(self.table(block), np.int32)
            out.append(base + t[2 if i == 0 else 1 :])
            base += int(t[-1])
        return np.concatenate(out)

    def cut(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens."""
        blocks = self.split(text)
        ends = np.cumsum([0, *map(self.cache.__getitem__, blocks)])
        if ends[-1] <= budget:
            return len(text)
        if budget < 1:
            return 0
        k = int(np.searchsorted(ends, budget, side="left")) - 1
        table = self.table(blocks[k])
        inside = max(i for i, c in enumerate(table) if ends[k] + c <= budget)
        return max(0, sum(map(len, blocks[:k])) + inside - 1)


class Blocks(dict):
    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, block: str) -> int:
        n = self.counter.table(block)[-1]
        if len(self) < CACHE and len(block) <= 64:
            self[block] = n
        return n


_loaded: dict[str, PrefixCounter] = {}


def load(path: str) -> PrefixCounter:
    if path not in _loaded:
        _loaded[path] = PrefixCounter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens", prefixes: str | None = None, budget: int | None = None, cut: str = "cut_chars") -> DataFrame:
    """The columns of docs plus the token count; on request the whole prefix table as array<int>, and the code points that a budget leaves."""
    added = [T.StructField(n_tokens, T.LongType())]
    if prefixes:
        added.append(T.StructField(prefixes, T.ArrayType(T.IntegerType())))
    if budget is not None:
        added.append(T.StructField(cut, T.LongType()))
    rest = [f for f in docs.schema.fields if f.name.lower() not in {a.name.lower() for a in added}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for big in batches:
            for batch in slices(big, text):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                counts = [counter.count(t) for t in texts]
                arrays = [*(batch.column(f.name) for f in rest), pa.array(counts, pa.int64())]
                if prefixes:
                    arrays.append(pa.array([counter.prefixes(t) for t in texts], pa.list_(pa.int32())))
                if budget is not None:
                    arrays.append(pa.array([len(t) if n <= budget else counter.cut(t, budget) for t, n in zip(texts, counts, strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(arrays, [*(f.name for f in rest), *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*rest, *added]))
