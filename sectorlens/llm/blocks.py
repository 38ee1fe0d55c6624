"""Blocks of texts that exchange hashes through buckets, shared by the two substring operators.

Texts travel as compressed record batches. A block deals its distinct hashes out to
buckets by their leading bits, as sorted, delta-coded columns; a bucket sorts what all
blocks sent and tells each block the numbers of those that others hold too. A block
sends a hash at most once, so that the most common one brings a bucket no more than
one entry a block, and neither rows nor tasks follow how often something is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import trim, written
from .superkmers import U, block_runs

#: The hashes of the tokens of each text of a block.
Values = Callable[[pa.Table], list[np.ndarray]]
#: Bytes of text of a block, a bound of a Python worker's memory (a longer text is a block of its own).
BLOCK = 4_000_000
#: Blocks whose anchors, on average, meet in one bucket.
BLOCKS_A_BUCKET = 4


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return len(x).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n + 1), np.uint8)
    return planes.reshape(8, n).T.copy().view(np.uint64).ravel()


def pack_all(*arrays: np.ndarray) -> bytes:
    parts = [pack(x.astype(np.int64)) for x in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_all(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack(data[at + 8 : at + 8 + n]).view(np.int64))
        at += 8 + n
    return out


def batch_bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def texts_of(table: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in table.column("text").to_pylist()]


def to_blocks(docs: DataFrame) -> DataFrame:
    """(data, block): rows of docs, which has a text column, as compressed record batches of about BLOCK bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in (part for big in batches for part in slices(big, "text", BLOCK)):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK // 2:
                yield pa.RecordBatch.from_arrays([pa.array([batch_bytes(held)], pa.binary())], ["data"])
                held, size = [], 0
                trim()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([batch_bytes(held)], pa.binary())], ["data"])

    return docs.mapInArrow(run, "data binary").withColumn("block", F.monotonically_increasing_id())


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the keys, the last one first, and where in it a new pair of the last two keys begins."""
    order = np.lexsort(keys)
    a, b = keys[-1][order], keys[-2][order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.empty(0, np.int64)


def anchor_bits(blocks: int) -> int:
    """Leading bits of an anchor that travel: ten more than number the anchors, so that one in a thousand stays that nobody shares. Nothing rests on them but who goes on."""
    return min(64, 30 + max(1, blocks - 1).bit_length())


def shared_anchors(blocks: DataFrame, values: Values, length: int, k: int, buckets: int, bits: int) -> DataFrame:
    """(block, anchors): packed leading bits of a block's anchors that another block holds too; a row for each block and bucket at most."""
    shift = U(bits - max(1, (buckets - 1).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                a = np.unique(block_runs(values(opened(data.as_py())), length, k)[3].view(np.uint64) >> U(64 - bits))
                part = (a >> shift).astype(np.int64)
                ends = np.searchsorted(part, np.arange(part.max() + 2)) if len(a) else np.zeros(1, np.int64)
                out = [(b % buckets, block, pack(np.diff(a[i:j], prepend=U(0)))) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["bucket", "block", "data"])
                trim()

    def meet(table: pa.Table) -> pa.Table:
        ids = table.column("block").to_numpy()
        parts = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for x in table.column("data")]
        a, at = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        parts.clear()
        order = np.argsort(a, kind="stable")
        a, at = a[order], at[order]
        # a block whose anchors reach one bucket in two parts has none of them twice
        again = a[1:] == a[:-1]
        keep = np.r_[False, again] | np.r_[again, False]
        a, at = a[keep], at[keep]
        order = np.argsort(at, kind="stable")
        a, at = a[order], at[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
        ends = np.r_[first[1:], len(at)]
        return pa.table({"block": pa.array(ids[at[first]], pa.int64()), "anchors": pa.array([pack(np.diff(a[i:j], prepend=U(0))) for i, j in zip(first, ends, strict=False)], pa.binary())})

    return blocks.mapInArrow(send, "bucket int, block long, data binary").groupBy("bucket").applyInArrow(meet, "block long, anchors binary")


PARTS = "kind int, bucket int, block long, data binary"
STATE, PAIRS, KINDS, COPIES = 0, 1, 2, 3


class Parts:
    """Record batches of what a block keeps for itself and what it sends to buckets."""

    def __init__(self, block: int, buckets: int):
        self.block, self.buckets = block, buckets
        self.rows: list[tuple[int, int, bytes]] = []

    def keep(self, *arrays: np.ndarray) -> Parts:
        self.rows.append((STATE, 0, pack_all(*arrays)))
        return self

    def send(self, kind: int, key: np.ndarray, *arrays: np.ndarray, bits: int = 64) -> Parts:
        """Sorted keys and what belongs to each go to buckets by the keys' leading bits, with the number of the first of them."""
        part = (key >> U(bits - max(1, (self.buckets - 1).bit_length()))).astype(np.int64)
        ends = np.searchsorted(part, np.arange(part.max() + 2)) if len(key) else np.zeros(1, np.int64)
        for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if i < j:
                self.rows.append((kind, b % self.buckets, pack_all(np.array([i]), np.diff(key[i:j], prepend=U(0)).view(np.int64), *(x[i:j] for x in arrays))))
        return self

    def batch(self) -> pa.RecordBatch:
        kinds, buckets, data = zip(*self.rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array([self.block] * len(data), pa.int64()), pa.array(data, pa.binary())], ["kind", "bucket", "block", "data"])


def meet(table: pa.Table) -> pa.Table:
    """A bucket: sorts what all blocks sent and tells each block the numbers of its pairs that a smaller document has too (PAIRS) or another block has too (COPIES), or of its anchors with several contents (KINDS)."""
    kind = table.column("kind")[0].as_py()
    ids = table.column("block").to_numpy()
    numbers, keys, one, two = [], [], [], []
    for data in table.column("data"):
        (start,), key, a, b = unpack_all(data.as_py())
        keys.append(np.cumsum(key.view(np.uint64), dtype=np.uint64))
        numbers.append(np.arange(start, start + len(key)))
        one.append(a)
        two.append(a ^ b if kind == KINDS else b)
    at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key, number, a, b = (np.concatenate(x) for x in (keys, numbers, one, two))
    keys.clear(), numbers.clear(), one.clear(), two.clear()
    order = np.lexsort((key,) if kind == KINDS else (b, a, key))
    key, number, a, b, at = key[order], number[order], a[order], b[order], at[order]
    new = key[1:] != key[:-1]
    first = np.flatnonzero(np.r_[True, new if kind == KINDS else new | (a[1:] != a[:-1])])
    sizes = np.diff(np.r_[first, len(key)])
    if kind == PAIRS:
        told = b > np.repeat(b[first], sizes)
    else:
        told = np.repeat(sizes > 1 if kind == COPIES else np.minimum.reduceat(a, first) != np.maximum.reduceat(b, first), sizes)
    number, at = number[told], at[told]
    order = np.lexsort((number, at))
    number, at = number[order], at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    ends = np.r_[first[1:], len(at)]
    trim()
    return pa.table({"kind": pa.array([kind] * len(first), pa.int32()), "block": pa.array(ids[at[first]], pa.int64()), "told": pa.array([pack(np.diff(number[i:j], prepend=0)) for i, j in zip(first, ends, strict=False)], pa.binary())})


def marked(replies: pa.Scalar, n: int) -> np.ndarray:
    """Which of a block's n numbers the buckets have told."""
    out = np.zeros(n, bool)
    for x in replies.as_py() or ():
        out[np.cumsum(unpack(x).view(np.int64))] = True
    return out


def answers(parts: DataFrame) -> DataFrame:
    """(block, gone, several): what the buckets tell each block."""
    told = written(parts.where(f"kind <> {STATE}").groupBy("kind", "bucket").applyInArrow(meet, "kind int, block long, told binary"))
    of = lambda *kinds: F.collect_list(F.when(F.col("kind").isin(*kinds), F.col("told")))
    return told.groupBy("block").agg(of(PAIRS, COPIES).alias("gone"), of(KINDS).alias("several"))


def own(parts: DataFrame) -> DataFrame:
    """(block, state): what each block kept for itself."""
    return parts.where(f"kind = {STATE}").select("block", F.col("data").alias("state"))
