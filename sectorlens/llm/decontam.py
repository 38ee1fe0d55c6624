"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, k-grams of words are hashed from these, and of the k-grams in each
window of `length` words the one with the smallest hash (the first among equals) is
kept, with its place. Neighbouring windows mostly keep the same one: only distinct
k-grams remain, about a third of all. A window found in both tables keeps the same
k-gram at the same offset in both, so joining the kept hashes meets every shared
window (items shorter than a window form one of their own size). Each hit is then
extended word by word to all windows around its k-gram, so the result is exact; hit
windows merge into spans.

The benchmark's kept k-grams are broadcast only if their counted number and bytes are
within `broadcast_rows` and BROADCAST_BYTES. Beyond that, a first join on the distinct
hashes picks the documents that have any, and a second one compares the words around
those documents' k-grams, both by shuffle.

Cases: null texts and texts without words have no words and no hits; an item without
words has no window; documents equal in id and text share one row of hits and each
give a row; repeated items all count under their ids; empty tables give no hits;
clashing column names are replaced; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let

LENGTH, GRAM = 10, 6
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
#: Low bits of a kept k-gram, for its place: no text has more words. The hash has the rest, as words are compared afterwards.
PLACE = 30


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def lowered(text: Column) -> Column:
    """A-Z in lower case, other characters kept."""
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and characters beyond ASCII; A-Z are lower-cased before."""
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-z\x80-\x{10FFFF}]++")).cast("long")


def fingerprints(words: Column, length: int) -> Column:
    """The distinct k-grams kept by the windows of `length` words, as hash (high bits) and place (low bits); null if there is no window."""
    k = min(GRAM, length)
    width = length - k + 1
    high = -(1 << PLACE)

    def grams(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(h[i + j] for j in range(k))).bitwiseAND(high).bitwiseOR(i.cast("long")))

    def least(g: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(g) - width), lambda i: F.least(*(g[i + j] for j in range(width))) if width > 1 else g[i])

    return F.when(F.size(words) >= length, F.array_distinct(let(let(F.transform(words, lambda w: F.xxhash64(w)), grams), least)))


def gram_hash(kept: str) -> Column:
    return F.col(kept).bitwiseAND(-(1 << PLACE))


def gram_place(kept: str) -> Column:
    return F.col(kept).bitwiseAND((1 << PLACE) - 1).cast("int")


def around(words: Column, place: Column, length: int) -> tuple[Column, Column]:
    """The words of all windows around the k-gram at a place, and how many of them stand before it."""
    reach = length - min(GRAM, length)
    before = F.least(place, F.lit(reach))
    return F.slice(words, place - before + 1, before + length), before


def item_grams(items: DataFrame, length: int, whole: bool) -> DataFrame:
    """(fp, near, before, items): kept k-grams of the benchmark with the words around them and the sorted ids of the items that hold these."""
    rows = items.where(F.size("words") == length if whole else F.size("words") >= length)
    rows = rows.select("item", "words", F.explode_outer(fingerprints(F.col("words"), length)).alias("kept"))
    near, before = around(F.col("words"), gram_place("kept"), length)
    return rows.select("item", gram_hash("kept").alias("fp"), near.alias("near"), before.alias("before")).groupBy("fp", "near", "before").agg(F.array_sort(F.collect_set("item")).alias("items"))


def extended(near: Column, before: Column, item_near: Column, item_before: Column, length: int) -> Column:
    """Offsets of the k-gram in the windows around it that are equal in document and item."""

    def equal(o: Column) -> Column:
        inside = (o <= before) & (o <= item_before) & (item_before - o + length <= F.size(item_near))
        return inside & (F.slice(near, before - o + 1, F.lit(length)) == F.slice(item_near, item_before - o + 1, F.lit(length)))

    return F.filter(F.lit(list(range(length - min(GRAM, length) + 1))), lambda o: F.when((o <= before) & (o <= item_before), equal(o)).otherwise(F.lit(False)))


def hits(docs: DataFrame, known: DataFrame, length: int, broadcast_rows: int) -> DataFrame:
    """(id, h, s, e, items): windows of docs(id, h, words) that the benchmark holds."""
    kept = docs.withColumn("kept", fingerprints(F.col("words"), length))
    items = known.select(F.col("fp").alias("item_fp"), F.col("near").alias("item_near"), F.col("before").alias("item_before"), "items")
    size = known.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("near", "items")))).alias("bytes")).first()
    near, before = around(F.col("words"), gram_place("kept"), length)
    rows = lambda df: df.select("id", "h", "words", F.explode_outer("kept").alias("kept"))  # noqa: E731  outer, so that no filter repeats the fingerprints
    if size.n > broadcast_rows or (size.bytes or 0) > BROADCAST_BYTES:
        some = kept.select("id", "h", F.explode(F.array_distinct(F.transform("kept", lambda x: x.bitwiseAND(-(1 << PLACE))))).alias("fp")).join(known.select("fp").distinct(), "fp", "left_semi").select(F.col("id").alias("id2"), F.col("h").alias("h2")).distinct()
        chosen = kept.join(some, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left_semi")
        found = rows(chosen).select("id", "h", gram_hash("kept").alias("fp"), gram_place("kept").alias("place"), near.alias("near"), before.alias("before")).join(items, F.col("fp") == F.col("item_fp"))
    else:
        found = rows(kept).join(F.broadcast(items), gram_hash("kept") == F.col("item_fp")).select("id", "h", gram_place("kept").alias("place"), near.alias("near"), before.alias("before"), "item_near", "item_before", "items")
    found = found.select("id", "h", "place", "items", F.explode(extended(F.col("near"), F.col("before"), F.col("item_near"), F.col("item_before"), length)).alias("o"))
    return found.select("id", "h", (F.col("place") - F.col("o")).alias("s"), (F.col("place") - F.col("o") + length).alias("e"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = LENGTH, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns of docs plus n_words, n_hit, items (sorted ids as strings) and spans (hit windows, array<struct<s,e>>)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("words")).where("size(words) > 0")
    short = sorted(r.n for r in items.where(F.size("words") < length).select(F.size("words").alias("n")).distinct().collect())
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), words(F.col(text)).alias("words"))
    found = None
    for n, whole in [*((n, True) for n in short), (length, False)]:
        part = hits(rows, item_grams(items, n, whole), n, broadcast_rows)
        found = part if found is None else found.unionByName(part)
    per_doc = found.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    total = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).cast("long").alias("n")), lambda a: a["n"])
    per_doc = per_doc.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "spans", "items", total.alias("n_hit"))
    added = {"n_words", "n_hit", "items", "spans", "_id", "_h"}
    kept = docs.select(*(c for c in docs.columns if c.lower() not in added or c in (doc_id, text)))
    out = kept.withColumn("n_words", word_count(F.col(text))).withColumn("_key", F.xxhash64(text))
    out = out.join(per_doc, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h")), "left").drop("_id", "_h", "_key")
    empty = F.array().cast("array<string>")
    return out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", empty)})
