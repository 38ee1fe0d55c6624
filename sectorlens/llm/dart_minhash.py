"""Near-duplicates by DartMinHash signatures and banded joins.

A document is a weighted set of word shingles. Darts are thrown into the region of
each element (its weight wide, rank upwards): hashed exponential gaps place them, so
two documents that share an element share its darts up to the smaller weight. Each
dart falls on a coordinate of the signature, which keeps the earliest; the height
that is thrown at depends on the total weight, so a document takes about
k (ln k + 2) darts however long it is. Two signatures agree in a coordinate with the
weighted Jaccard similarity of the documents.

Signatures are cut into bands that are joined by hash. In each bucket all members
are compared with the smallest one; links join components (label propagation with
written rounds), and where a bucket still holds several components its pairs across
components are compared as well, so that no pair that shares a band is left out.
Before a pair is made, parity sketches bound its similarity from above: every cell
of the symmetric difference of two sets flips one bit, so the sets differ in at least
as many cells as their sketches in bits. No pair at the similarity is lost by that.
Pairs are verified exactly on their shingles. Exact copies (equal words) are grouped
before and are not expanded into pairs.

Cases: documents without words (null, empty) stay alone; under five words, the words
are one shingle; rows with a null id are returned with a null class; documents are
told apart by id and text, so rows that share an id but not the text have classes of
their own; an empty table gives an empty table; clashing column names are replaced;
texts are read whole; ids must be whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop, fresh, trim, written
from .superkmers import U, mix, row_key, word_values

WORDS, SIMILARITY = 5, 0.8
#: A pair at the similarity shares a band with probability 1 - (1 - 0.8^7)^48, over 0.99998; one at 0.3 with 0.01.
BANDS, ROWS = 48, 7
#: Longs of a parity sketch; sets that differ in more than half as many cells as it has bits are told apart less sharply.
SKETCH = 16
#: Document ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000
split = re.compile(r"\w+").findall


def shingles(words: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    if not words:
        return np.empty(0, U), np.empty(0, np.int64)
    v = word_values([w.encode() for w in words])
    n = min(size, len(v))
    h = v[: len(v) - n + 1].copy()
    for j in range(1, n):
        h = h * U(0x9E3779B97F4A7C15) + v[j : len(v) - n + 1 + j]
    return np.unique(mix(h), return_counts=True)


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int, extra: float = 2.0) -> np.ndarray:
    """DartMinHash of non-empty weighted sets (elements, weights): per set and coordinate the earliest dart, named by the bits of its rank."""
    totals = np.array([w.sum() for _, w in sets], np.float64)
    element, weight = (np.concatenate(x) for x in zip(*sets, strict=True))
    owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
    whole = np.ceil(weight).astype(np.int64)
    level = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    seed = mix(np.repeat(element, whole) ^ mix(level.astype(U) + U(1)))
    part = np.minimum(1.0, np.repeat(weight, whole) - level)  # the share of the unit cell that belongs to the element
    owner = np.repeat(owner, whole)
    height = ((np.log(k) + extra) / totals)[owner]
    fractions = bool((part < 1).any())
    rank, earliest = np.zeros(len(seed)), np.full(len(sets) * k, np.inf)
    while len(seed):
        seed = mix(seed + U(0x9E3779B97F4A7C15))
        rank = rank - np.log(uniform(seed)) / k
        live = np.flatnonzero(rank < height)
        seed, rank, owner, height = seed[live], rank[live], owner[live], height[live]
        slot = owner * k + (mix(seed ^ U(0xD6E8FEB86659FD93)) % U(k)).astype(np.int64)
        if fractions:
            part = part[live]
            hit = uniform(mix(seed ^ U(0xA0761D6478BD642F))) < part
            np.minimum.at(earliest, slot[hit], rank[hit])
        else:
            np.minimum.at(earliest, slot, rank)
    out = earliest.reshape(-1, k)
    empty = np.flatnonzero(np.isinf(out).any(axis=1))
    if len(empty):  # rare: a coordinate without a dart; the same darts and more, thrown higher
        out[empty] = signatures([sets[i] for i in empty], k, 2 * (np.log(k) + extra) - np.log(k)).view(np.float64)
    return out.view(U)


def sketches(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Parity sketches (rows of SKETCH longs) of multisets (elements, counts): each cell, an element at a level, flips one bit."""
    element, count = (np.concatenate(x) for x in zip(*sets, strict=True))
    owner = np.repeat(np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets]), count)
    level = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    cell = mix(np.repeat(element, count) ^ (level.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)) % U(64 * SKETCH)
    out = np.zeros(len(sets) * SKETCH, U)
    np.bitwise_xor.at(out, owner * SKETCH + (cell >> U(6)).astype(np.int64), U(1) << (cell & U(63)))
    return out.reshape(-1, SKETCH)


def may_reach(least: float, a: str, b: str) -> Column:
    """Whether sizes and sketches of two documents (columns `size` and `sketch` under the given prefixes) leave room for the similarity."""
    size = F.col(f"{a}size") + F.col(f"{b}size")
    apart = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(SKETCH)), F.lit(0))
    fits = F.least(f"{a}size", f"{b}size") >= least * F.greatest(f"{a}size", f"{b}size")
    return fits & (apart <= size * ((1 - least) / (1 + least)) + 1e-9)


def similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    return both / (int(na.sum()) + int(nb.sum()) - both) if len(a) and len(b) else 0.0


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): connected components of edges (a, b) by their smallest node. Small-star and large-star rounds, each written to the shared folder."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        last = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", class_id: str = "class_id", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, first: str | None = None) -> DataFrame:
    """The columns of docs plus class_id: the smallest id of the documents linked with it, directly or through others; on request also whether the row is the first of them by id and text hash."""
    if dict(docs.dtypes)[doc_id] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("document ids must be whole numbers, as the smallest names a class")
    k = bands * rows
    k2 = row_key(docs, doc_id, text)[1]
    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), k2.alias("t"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", 250_000):
                texts = [split((t or "").lower()) for t in batch.column("text").to_pylist()]
                at = [i for i, t in enumerate(texts) if t]
                if not at:
                    continue
                sets = [shingles(texts[i], words) for i in at]
                signed = signatures([(e, n.astype(np.float64)) for e, n in sets], k).reshape(-1, bands, rows)
                h = np.tile(np.arange(bands, dtype=U) + U(1), (len(at), 1))
                for j in range(rows):
                    h = mix(h * U(0x9E3779B97F4A7C15) ^ signed[:, :, j])
                keys = pa.array([xxhash.xxh3_128_digest(" ".join(texts[i]).encode()) for i in at], pa.binary())
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), batch.column("t").take(pa.array(at)), keys, pa.array([int(n.sum()) for _, n in sets]), pa.ListArray.from_arrays(offsets, pa.array(h.ravel().view(np.int64))), pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * SKETCH, pa.array(sketches(sets).ravel().view(np.int64)))], ["id", "t", "key", "size", "bands", "sketch"])
            trim()

    # one pass over the texts: a number for the row, its id and text hash, the key of its words, its band hashes and its sketch
    read_once = written(base.mapInArrow(read, "id long, t long, key binary, size long, bands array<long>, sketch array<long>").withColumn("node", F.monotonically_increasing_id()))
    # written, so that joins with it can split the rows of one key, the copies of one text
    groups = written(read_once.groupBy("key").agg(F.min("node").alias("rep"), F.min(F.struct("id", "t")).alias("low")))
    signed = read_once.join(groups.select("key", F.col("rep").alias("node")), ["key", "node"]).select("node", F.explode("bands").alias("band"))
    buckets = signed.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("band", "head")
    met = written(signed.join(buckets, "band"))
    known = written(read_once.join(met.select("node").distinct(), "node", "left_semi"))
    named = lambda x: known.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"))
    fits = lambda pairs: pairs.join(named("a"), "a").join(named("b"), "b").where(may_reach(least, "a_", "b_")).select("a", "b")
    stars = written(fits(met.where("node > head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, tuple] = ("", (np.empty(0, U), np.empty(0, np.int64)))
        for batch in (big.slice(i, 256) for big in batches for i in range(0, big.num_rows, 256)):
            keep = []
            for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if a != last[0]:
                    last = (a, shingles(split(a.lower()), words))
                keep.append(similarity(*last[1], *shingles(split(b.lower()), words)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])
            trim()

    wanted = known.select("node", "id", "t")
    if wanted.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = base.join(wanted, ["id", "t"]).groupBy("node").agg(F.min("text").alias("text"))  # a repeated row has its text once

    def linked(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        return written(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))

    links = linked(stars)
    comps = components(links)  # a written table
    placed = met.select("band", "node").join(comps, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    left = written(placed.join(mixed, "band").distinct().join(known, "node"))
    one, other = (left.select("band", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "comp", "size", "sketch", "bands"))) for x in "ab")
    once = F.col("band") == F.coalesce(F.array_min(F.array_intersect("a_bands", "b_bands")), "band")  # of the bands that a pair shares, one makes it
    pairs = one.join(other, "band").where("a_node < b_node and a_comp <> b_comp").where(may_reach(least, "a_", "b_") & once).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    pairs = pairs.join(stars, ["a", "b"], "left_anti")
    others = linked(pairs)
    comps = written(components(links.unionByName(others)).withColumnRenamed("node", "rep"))
    drop(met, known, stars, left, links, others)
    lowest = comps.join(groups, "rep").groupBy("comp").agg(F.min("low").alias("lowest"))
    lowest = comps.join(lowest, "comp").select("rep", "lowest")
    members = read_once.select("id", "t", "key").join(groups, "key").join(lowest, "rep", "left")
    classes = members.select("id", "t", F.coalesce("lowest", "low").alias("low")).select("id", "t", F.col("low.id").alias("class"), F.col("low.t").alias("class_t")).distinct()
    key, sub, found, found_t = fresh(docs, "key", "sub", "found", "found_t")
    rest = [c for c in docs.columns if c.lower() not in {class_id.lower(), (first or class_id).lower()}]
    out = docs.select(*rest, F.col(doc_id).cast("long").alias(key), k2.alias(sub)).join(classes.select(F.col("id").alias(key), F.col("t").alias(sub), F.col("class").alias(found), F.col("class_t").alias(found_t)), [key, sub], "left")
    is_first = F.when(F.col(key).isNotNull(), F.coalesce((F.col(found) == F.col(key)) & (F.col(found_t) == F.col(sub)), F.lit(True)))
    return out.select(*rest, F.coalesce(F.col(found), F.col(key)).alias(class_id), *([is_first.alias(first)] if first else []))
