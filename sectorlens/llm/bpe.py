"""BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that no vocabulary token holds side by side can never be merged
over, so every such pair in a text is a certain cut. A text is cut there, each
fragment is merged on its own and the ids are concatenated; the result equals
that of merging the whole text. White space occurs in no token, so words are
fragments too; within a word the pair table cuts further.

Cases: a null text counts as empty and gives no ids; an empty table gives an
empty table; repeated rows each give a row; columns of the input that clash with
an output name are replaced; a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import trim

#: Words kept with their ids by each Python worker; beyond it words are encoded anew.
CACHE = 100_000


#: Texts on which the fast word splitter must agree with the file's own rules.
PROBES = ("Don't we'll I'D x's", "ab12 3c-d--e ... !?", "É à'S ñ ÷½²", "  two  spaces\ttab\nline ", "a_b@c.d #1 (x)", "''s 'tis rock'n'roll'")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file with word ends (tokenizers JSON)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level BPE file with plain merges")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        alphabet = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
        self.joined = np.zeros((256, 256), bool)
        for token in vocab:
            raw = [self.byte_of[c] for c in (token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token)]
            self.joined[raw[:-1], raw[1:]] = True
        self.pairs = {a << 8 | b for a, b in zip(*np.nonzero(self.joined), strict=True)}
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.plain, self.words = latin_rules()
        if any(self.words(p.lower()) != self.alphabet_words(p) for p in PROBES):
            self.plain = bool  # another file's rules: every piece goes to its own splitter
        self.cache = Words(self)

    def alphabet_words(self, piece: str) -> list[str]:
        """The library's words of a piece, in plain characters."""
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.split(self.normalize(piece))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for i, piece in enumerate(self.cut_special.split(text)):
            if i % 2:
                out.append(self.special[piece])
            elif piece and not self.plain(piece):
                out.extend(chain.from_iterable(map(self.cache.__getitem__, self.words(piece.lower()))))
            elif piece:
                for word, _ in self.split(self.normalize(piece)):
                    out.extend(self.fragments(bytes(map(self.byte_of.__getitem__, word))))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def fragments(self, word: bytes) -> list[int]:
        """Ids of one word: cut where no token has both bytes, merge each fragment, concatenate."""
        pairs, out, start = self.pairs, [], 0
        for i in range(1, len(word)):
            if word[i - 1] << 8 | word[i] not in pairs:
                out += self.merge([self.inner[b] for b in word[start:i]])
                start = i
        ids = [self.inner[b] for b in word[start:]]
        ids[-1] = self.last[word[-1]]
        return out + self.merge(ids)

    def merge(self, ids: list[int]) -> list[int]:
        """Lowest merge rank first, leftmost among equals."""
        if len(ids) > 48:
            return self.merge_long(ids)
        known = self.merges.get
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = known(ids[i] << 20 | ids[i + 1])
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after, known = list(range(-1, n - 1)), list(range(1, n + 1)), self.merges.get
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := known(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := known(new << 20 | ids[after[i]]):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[after[i]]))
            if (h := before[i]) >= 0 and (m := known(ids[h] << 20 | new)):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]


class Words(dict):
    """Ids of the words seen so far, of bounded size."""

    def __init__(self, bpe: ForcedBoundaryBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.bpe.fragments(word.encode()))
        if len(self) < CACHE and len(word) <= 64:
            self[word] = ids
        return ids


def latin_rules():
    """For texts of ASCII and Latin letters only, where every Unicode version agrees: a search for other characters, and the word splitter."""
    chars = [chr(c) for c in chain(range(32, 127), range(0xA1, 0x250)) if c != 0x130]
    of = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    letters, numbers = of("L"), of("N")
    other = "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] not in "LN" and c != " ")
    plain = re.compile(rf"[^\t\n\r {letters}{numbers}{other}]").search
    return plain, re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[{other}]+").findall


_loaded: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns of docs plus `ids` (array<int>) and, if named, `decoded` (the text that the ids decode to)."""
    rest = [f for f in docs.schema.fields if f.name.lower() not in {ids.lower(), (decoded or ids).lower()}]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for big in batches:
            for batch in slices(big, text):
                rows = [bpe.encode(t or "") for t in batch.column(text).to_pylist()]
                offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
                arrays = [batch.column(n) for n in names]
                arrays.append(pa.ListArray.from_arrays(offsets, pa.array(np.fromiter(chain.from_iterable(rows), np.int32, offsets[-1]))))
                if decoded:
                    arrays.append(pa.array(map(bpe.decode, rows), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, ids, *([decoded] if decoded else [])])
            trim()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of df plus the text of `ids`; null ids decode to null."""
    rest = [f for f in df.schema.fields if f.name.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(texts, pa.string())], [*(f.name for f in rest), out])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.StringType())]))


def slices(batch: pa.RecordBatch, text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text each, to bound what is held at once."""
    column = batch.column(text)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    part, start = (np.cumsum(sizes) // most), 0
    ends = [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end
