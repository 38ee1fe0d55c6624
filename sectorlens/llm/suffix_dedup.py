"""Repeated byte strings by prefix doubling over the positions that may still repeat.

Positions are ranked by growing prefixes, and a position leaves as soon as its rank
is its own. Doubling from one byte would sort every byte position in every round; here
it starts at 24 bytes and, until the last round, at one position for each half run:
the anchor that neighbouring 50-byte windows share (see superkmers). A window repeats
only if its anchor does, at the same offset. Ranks are 64-bit hashes of the bytes
rather than ordinals: equal exactly if the strings are, which is all that is asked.

1. Anchors, 24 bytes grown by half of a window's other bytes to 37 or 38. Blocks of
   documents send their distinct anchors, sorted and delta-coded, to buckets by
   leading bits; the buckets tell each block which of them other blocks hold too.
   Half runs whose anchor only one document holds leave.
2. Pairs (anchor, content of the half run). Equal pairs have equal windows: all but
   the smallest document's go at once. Pairs that are alone with their anchor leave.
3. Where different half runs share an anchor, the smallest document's one of each kind
   is opened into its windows, and the pairs (rank of the first 25 bytes, rank of the 25
   bytes at offset 25) are ranked: the doubling step that passes the threshold.

Documents travel as compressed blocks, written once. In each round every block deals
its ranks out to buckets as sorted, packed columns; a bucket sorts what all blocks
sent and tells each the numbers of the pairs that go, or must go on. A block sends a
pair at most once, with the smallest id that it has there, and pairs are dealt by
content, so that no rank, however common, brings a bucket more than one entry a block.

A byte goes if a 50-byte string over it also starts in a document with a smaller
id. Cases: null texts count as empty; texts under 50 bytes keep all; null ids sort
before all others and rows with equal ids don't remove each other; ids must be whole
numbers; an empty table gives an empty table; clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCKS_A_BUCKET, KINDS, PAIRS, PARTS, Parts, anchor_bits, answers, grouped, marked, opened, own, shared_anchors, texts_of, to_blocks, unpack, unpack_all
from .common import drop, trim, written
from .superkmers import U, Windows, block_runs, byte_values, chunks

LENGTH, ANCHOR = 50, 24


def several_texts(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Sorted anchors that more than one text of a block holds."""
    order = np.lexsort((doc, anchor))
    a, d = anchor[order], doc[order]
    return np.unique(a[1:][(a[1:] == a[:-1]) & (d[1:] != d[:-1])])


def byte_hashes(table: pa.Table) -> list[np.ndarray]:
    return [byte_values(t) for t in texts_of(table)]


def anchor_size(length: int) -> int:
    return min(ANCHOR, max(1, length // 2))


def runs(batches: Iterator[pa.RecordBatch], length: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Round 2: of each block the half runs whose anchors another document holds, as pairs (content, anchor)."""
    for batch in batches:
        for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("anchors"), strict=True):
            table = opened(data.as_py())
            doc, start, count, anchor, content = block_runs(byte_hashes(table), length, anchor_size(length))
            a = anchor.view(np.uint64)
            short = a >> U(64 - bits)
            shared = np.unique(np.concatenate([several_texts(doc, short), *(np.cumsum(unpack(x), dtype=np.uint64) for x in replies.as_py() or ())]))
            if not len(shared):
                continue
            keep = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
            doc, start, count, a, c = (v[keep] for v in (doc, start, count, a, content.view(np.uint64)))
            k1 = table.column("k1").to_numpy()[doc]
            order, first = grouped(k1, a, c)
            x, y = a[order][first], c[order][first]
            anchors, which = np.unique(x >> U(64 - bits), return_inverse=True)
            by_anchor = np.lexsort((y.view(np.int64), which))
            begin = np.searchsorted(which[by_anchor], np.arange(len(anchors)))
            low, high = y.view(np.int64)[by_anchor[begin]], y.view(np.int64)[by_anchor[np.r_[begin[1:], len(y)] - 1]]
            yield Parts(block, buckets).keep(np.diff(first, prepend=0), doc[order], (start * 1024 + count)[order], which).send(PAIRS, y, (x >> U(32)).view(np.int64), k1[order][first]).send(KINDS, anchors, low, low ^ high, bits=bits).batch()
            trim()


def windows(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Round 3: the windows of the half runs to be opened, as pairs (rank of the first half, rank of the last half)."""
    half = length - length // 2
    for batch in batches:
        for block, data, state, gone, several in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in ("data", "state", "gone", "several")), strict=True):
            first, doc, p, which = unpack_all(state.as_py())
            first = np.cumsum(first)
            kind = np.flatnonzero(marked(several, int(which.max()) + 1)[which] & ~marked(gone, len(first)))
            if not len(kind):
                continue
            table = opened(data.as_py())
            texts, k1 = texts_of(table), table.column("k1").to_numpy()
            run = first[kind]
            order = np.argsort(doc[run], kind="stable")
            kind, run = kind[order], run[order]
            found = []
            for i, j in chunks(texts):
                low, high = np.searchsorted(doc[run], [i, j])
                if low == high:
                    continue
                sizes = np.array([len(t) for t in texts[i:j]], np.int64)
                w = Windows(byte_values(b"".join(texts[i:j])), length, 1)
                base = np.cumsum(sizes) - sizes
                n = p[run[low:high]] % 1024
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base[doc[run[low:high]] - i] + p[run[low:high]] // 1024, n) + off
                found.append((np.repeat(kind[low:high], n), off, w.span_hash(at, at + half), w.span_hash(at + length - half, at + length)))
            kind, off, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            low = k1[doc[first[kind]]]
            order, begin = grouped(low, y, x)
            yield Parts(block, buckets).keep(np.diff(begin, prepend=0), kind[order], off[order]).send(PAIRS, x[order][begin], (y[order][begin] >> U(24)).view(np.int64), low[order][begin]).batch()
            trim()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept", n_bytes: str = "n_bytes", n_removed: str = "n_removed", spans: str = "spans", length: int = LENGTH) -> DataFrame:
    """The columns of docs without the text, plus what is left of it (binary), the byte counts and the maximal removed spans (array<struct<s,e>> of byte positions)."""
    if not 2 <= length < 1024:
        raise ValueError("length must be 2 to 1023")
    if dict(docs.dtypes)[doc_id] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("document ids must be whole numbers, as the smallest keeps its text")
    new = [T.StructField(out, T.BinaryType()), T.StructField(n_bytes, T.LongType()), T.StructField(n_removed, T.LongType()), T.StructField(spans, T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])))]
    rest = [f for f in docs.schema.fields if f.name.lower() not in {x.name.lower() for x in new} | {text.lower()}]
    keyed = docs.select(F.struct(*(F.col(f.name) for f in rest)).alias("rest"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("k1"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = ("data", "state", "gone", "state3", "gone3")
            for data, state, gone, state3, gone3 in zip(*(batch.column(c) for c in columns), strict=True):
                table = opened(data.as_py())
                texts, k1 = texts_of(table), table.column("k1").to_numpy()
                sizes = np.array([len(t) for t in texts], np.int64)
                base = np.cumsum(sizes + 1) - sizes - 1  # a gap after each text, so that no span goes on into the next
                steps = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
                mark = lambda d, s, e, base=base, steps=steps: (np.add.at(steps, base[d] + s, 1), np.add.at(steps, base[d] + e, -1))
                if state.is_valid:
                    first, doc, p, _ = unpack_all(state.as_py())
                    first = np.cumsum(first)
                    sizes_ = np.diff(np.r_[first, len(doc)])
                    low = k1[doc[first]]
                    pair = np.repeat(np.arange(len(first)), sizes_)
                    later = k1[doc] > low[pair]
                    whole = later | marked(gone, len(first))[pair]
                    mark(doc[whole], p[whole] // 1024, p[whole] // 1024 + p[whole] % 1024 - 1 + length)
                    if state3.is_valid:
                        begin, kind, off = unpack_all(state3.as_py())
                        begin = np.cumsum(begin)
                        group = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(kind)]))
                        hit = marked(gone3, len(begin))[group] | (low[kind] > low[kind[begin]][group])
                        kind, off = kind[hit], off[hit]
                        twins = np.bincount(pair[~later], minlength=len(first))[kind]  # the smallest document's equal half runs
                        run = np.repeat(first[kind], twins) + np.arange(twins.sum()) - np.repeat(np.cumsum(twins) - twins, twins)
                        s = p[run] // 1024 + np.repeat(off, twins)
                        mark(doc[run], s, s + length)
                covered = np.cumsum(steps[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, covered, False])).reshape(-1, 2)
                owner = np.searchsorted(base, edge[:, 0], side="right") - 1
                gap = np.zeros(len(covered), bool)
                gap[base + sizes] = True
                kept = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)[~covered & ~gap]
                lost = np.add.reduceat(covered, base, dtype=np.int64) if len(texts) else sizes
                ends = np.r_[0, np.cumsum(sizes - lost)].astype(np.int32)
                struct = pa.StructArray.from_arrays([pa.array(edge[:, 0] - base[owner]), pa.array(edge[:, 1] - base[owner])], ["s", "e"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)), struct)
                left = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
                fields = table.column("rest").combine_chunks().flatten()
                yield pa.RecordBatch.from_arrays([*fields, left, pa.array(sizes), pa.array(lost), lists], [*(f.name for f in rest), *(f.name for f in new)])
                trim()

    blocks = written(to_blocks(keyed))
    n = blocks.count()
    bits = anchor_bits(n)
    replies = written(shared_anchors(blocks, byte_hashes, length, anchor_size(length), max(4, -(-n // BLOCKS_A_BUCKET)), bits))
    buckets = max(4, -(-n // (2 * BLOCKS_A_BUCKET)))
    second = blocks.join(replies.groupBy("block").agg(F.collect_list("anchors").alias("anchors")), "block", "left").select("block", "data", "anchors")
    parts = written(second.mapInArrow(lambda b: runs(b, length, buckets, bits), PARTS))
    drop(replies)
    told, state = answers(parts), written(own(parts))
    drop(parts)
    third = blocks.join(state, "block").join(told.where("size(several) > 0"), "block").select("block", "data", "state", "gone", "several")
    parts3 = written(third.mapInArrow(lambda b: windows(b, length, buckets), PARTS))
    told3, state3 = answers(parts3).withColumnRenamed("gone", "gone3"), written(own(parts3).withColumnRenamed("state", "state3"))
    drop(parts3)
    last = blocks.join(state, "block", "left").join(told, "block", "left").join(state3, "block", "left").join(told3, "block", "left")
    return last.select("data", "state", "gone", "state3", "gone3").mapInArrow(apply, T.StructType([*rest, *new]))
