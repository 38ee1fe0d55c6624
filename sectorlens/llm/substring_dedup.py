"""Repeated word spans, by half runs of word windows.

The edges are windows of `length` words. Neighbouring windows of one document with one
anchor form a half run (see superkmers), a path of edges that travels as one. These
stand in for the nonbranching paths of a compacted De Bruijn graph: there are no
nodes, no test for branches and no join that grows paths. Rounds, by the exchange of
blocks:

1. Anchors (grown to about half a window). Half runs whose anchor occurs once hold no
   repeated edge and leave.
2. Paths, as pairs (content, anchor). Those that occur twice or more, in any document,
   are repeated with all their edges.
3. Where different paths share an anchor, one of each kind is opened into its edges, as
   pairs (hash of the first half, hash of the last half of the words); edges that
   several kinds hold are repeated.

Repeated paths and edges return to their documents by coordinate, where they merge into
maximal spans; every word of a span is removed, at all its occurrences. A block sends
an anchor, path or edge at most once, however often it has it, so that the most common
line makes no task larger than others. Equal words have equal hashes; paths and edges
are told apart by 96 bits and more, spans are not compared word by word afterwards.

Cases: words are runs of anything but ASCII white space; null texts have none;
texts under `length` words keep all; a repeated row repeats all its windows; an
empty table gives an empty table; clashing column names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCKS_A_BUCKET, COPIES, KINDS, PARTS, Parts, anchor_bits, answers, grouped, marked, opened, own, shared_anchors, texts_of, to_blocks, unpack, unpack_all
from .common import drop, fresh, trim, written
from .superkmers import U, Windows, block_runs, chunks, word_values

LENGTH, ANCHOR = 35, 6


def word_hashes(table: pa.Table) -> list[np.ndarray]:
    return [word_values(t.split()) for t in texts_of(table)]


def anchor_size(length: int) -> int:
    return min(ANCHOR, max(1, length // 3))


def paths(batches: Iterator[pa.RecordBatch], length: int, buckets: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Round 2: of each block the half runs whose anchors occur again, as pairs (content, anchor)."""
    for batch in batches:
        for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("anchors"), strict=True):
            doc, start, count, anchor, content = block_runs(word_hashes(opened(data.as_py())), length, anchor_size(length))
            a = anchor.view(np.uint64)
            short = a >> U(64 - bits)
            known, times = np.unique(short, return_counts=True)
            shared = np.unique(np.concatenate([known[times > 1], *(np.cumsum(unpack(x), dtype=np.uint64) for x in replies.as_py() or ())]))
            if not len(shared):
                continue
            keep = shared[np.minimum(np.searchsorted(shared, short), len(shared) - 1)] == short
            doc, start, count, a, c = (v[keep] for v in (doc, start, count, a, content.view(np.uint64)))
            order, first = grouped(start, a, c)
            x, y = a[order][first], c[order][first]
            anchors, which = np.unique(x >> U(64 - bits), return_inverse=True)
            by_anchor = np.lexsort((y.view(np.int64), which))
            begin = np.searchsorted(which[by_anchor], np.arange(len(anchors)))
            low, high = y.view(np.int64)[by_anchor[begin]], y.view(np.int64)[by_anchor[np.r_[begin[1:], len(y)] - 1]]
            parts = Parts(block, buckets).keep(np.diff(first, prepend=0), doc[order], (start * 1024 + count)[order], which)
            yield parts.send(COPIES, y, (x >> U(32)).view(np.int64), np.zeros(len(y), np.int64)).send(KINDS, anchors, low, low ^ high, bits=bits).batch()
            trim()


def edges(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Round 3: the edges of one path of each kind that shares its anchor with others."""
    half = length - length // 2
    for batch in batches:
        for block, data, state, several in zip(batch.column("block").to_pylist(), *(batch.column(c) for c in ("data", "state", "several")), strict=True):
            first, doc, p, which = unpack_all(state.as_py())
            first = np.cumsum(first)
            times = np.diff(np.r_[first, len(doc)])
            kind = np.flatnonzero(marked(several, int(which.max()) + 1)[which])
            if not len(kind):
                continue
            texts = texts_of(opened(data.as_py()))
            run = first[kind]
            order = np.argsort(doc[run], kind="stable")
            kind, run = kind[order], run[order]
            wanted = np.unique(doc[run])
            values = [word_values(texts[i].split()) for i in wanted]
            place = np.searchsorted(wanted, doc[run])
            found = []
            for i, j in chunks(values):
                low, high = np.searchsorted(place, [i, j])
                sizes = np.array([len(v) for v in values[i:j]], np.int64)
                w = Windows(np.concatenate(values[i:j]), length, 1)
                base = np.cumsum(sizes) - sizes
                n = p[run[low:high]] % 1024
                off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(base[place[low:high] - i] + p[run[low:high]] // 1024, n) + off
                found.append((np.repeat(kind[low:high], n), off, w.span_hash(at, at + half), w.span_hash(at + length - half, at + length)))
            kind, off, x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            order, begin = grouped(off, y, x)
            again = np.add.reduceat(times[kind[order]], begin) > 1
            x, y = x[order][begin], y[order][begin]
            yield Parts(block, buckets).keep(np.diff(begin, prepend=0), kind[order], off[order], again).send(COPIES, x, (y >> U(24)).view(np.int64), np.zeros(len(x), np.int64)).batch()
            trim()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "kept_text", n_words: str = "n_words", n_removed: str = "n_removed", length: int = LENGTH, spans: str | None = None) -> DataFrame:
    """The columns of docs plus the text without the words of repeated windows (joined by one space), the two counts and, if named, the maximal removed spans (array<struct<s,e>> of word places)."""
    if not 2 <= length < 1024:
        raise ValueError("length must be 2 to 1023")
    new = [T.StructField(out, T.StringType()), T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType()), *([T.StructField(spans, T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())])))] if spans else [])]
    shown = [f for f in docs.schema.fields if f.name.lower() not in {x.name.lower() for x in new}]
    rest = [f for f in shown if f.name != text]
    (row,) = fresh(docs, "row")
    columns = [F.struct(F.lit(0).alias(row), *(F.col(f.name) for f in rest)).alias("rest"), F.col(text).alias("text")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, state, gone, state3, gone3 in zip(*(batch.column(c) for c in ("data", "state", "gone", "state3", "gone3")), strict=True):
                table = opened(data.as_py())
                words = [t.split() for t in texts_of(table)]
                sizes = np.array([len(w) for w in words], np.int64)
                base = np.cumsum(sizes + 1) - sizes - 1  # a gap after each text, so that no span goes on into the next
                steps = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
                mark = lambda d, s, e, base=base, steps=steps: (np.add.at(steps, base[d] + s, 1), np.add.at(steps, base[d] + e, -1))
                if state.is_valid:
                    first, doc, p, _ = unpack_all(state.as_py())
                    first = np.cumsum(first)
                    times = np.diff(np.r_[first, len(doc)])
                    repeated = (times > 1) | marked(gone, len(first))
                    whole = np.repeat(repeated, times)
                    mark(doc[whole], p[whole] // 1024, p[whole] // 1024 + p[whole] % 1024 - 1 + length)
                    if state3.is_valid:
                        begin, kind, off, again = unpack_all(state3.as_py())
                        begin = np.cumsum(begin)
                        hit = np.repeat(marked(gone3, len(begin)) | (again > 0), np.diff(np.r_[begin, len(kind)])) & ~repeated[kind]
                        run = first[kind[hit]]  # paths that aren't repeated occur once
                        s = p[run] // 1024 + off[hit]
                        mark(doc[run], s, s + length)
                covered = np.cumsum(steps[:-1]) > 0
                lost = np.add.reduceat(covered, base, dtype=np.int64)
                kept = [b" ".join(compress(w, (~covered[b : b + n]).tolist()) if x else w).decode() for w, b, n, x in zip(words, base.tolist(), sizes.tolist(), lost.tolist(), strict=True)]
                arrays = dict(zip((row, *(f.name for f in rest)), table.column("rest").combine_chunks().flatten(), strict=True))
                arrays |= {text: table.column("text").combine_chunks(), out: pa.array(kept, pa.string()), n_words: pa.array(sizes), n_removed: pa.array(lost)}
                if spans:
                    edge = np.flatnonzero(np.diff(np.r_[False, covered, False])).reshape(-1, 2)
                    owner = np.searchsorted(base, edge[:, 0], side="right") - 1
                    struct = pa.StructArray.from_arrays([pa.array(edge[:, 0] - base[owner]), pa.array(edge[:, 1] - base[owner])], ["s", "e"])
                    arrays[spans] = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words) + 1)).astype(np.int32)), struct)
                names = [f.name for f in (*shown, *new)]
                yield pa.RecordBatch.from_arrays([arrays[x] for x in names], names)
                trim()

    blocks = written(to_blocks(docs.select(*columns)))
    n = blocks.count()
    bits, buckets = anchor_bits(n), max(4, -(-n // (2 * BLOCKS_A_BUCKET)))
    replies = written(shared_anchors(blocks, word_hashes, length, anchor_size(length), buckets, bits))
    second = blocks.join(replies.groupBy("block").agg(F.collect_list("anchors").alias("anchors")), "block", "left").select("block", "data", "anchors")
    parts = written(second.mapInArrow(lambda b: paths(b, length, buckets, bits), PARTS))
    drop(replies)
    told, state = answers(parts), written(own(parts))
    drop(parts)
    third = blocks.join(state, "block").join(told.where("size(several) > 0"), "block").select("block", "data", "state", "several")
    parts3 = written(third.mapInArrow(lambda b: edges(b, length, buckets), PARTS))
    told3, state3 = answers(parts3).withColumnRenamed("gone", "gone3"), written(own(parts3).withColumnRenamed("state", "state3"))
    drop(parts3)
    last = blocks.join(state, "block", "left").join(told, "block", "left").join(state3, "block", "left").join(told3, "block", "left")
    return last.select("data", "state", "gone", "state3", "gone3").mapInArrow(apply, T.StructType([*shown, *new]))
