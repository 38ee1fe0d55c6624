"""Ranks within a population, scores and the composite."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BUCKETS, CORE, WEIGHTS


def ranks(metrics: DataFrame, population: list[str] | None = None, buckets: int = BUCKETS, prefix: int = 1) -> DataFrame:
    """Adds rank (0-based, by bucket and then entity; 0 if excluded), n_valid and score.

    A firm's rank is the number of firms in the groups before its own and its place
    among its group. A group is a bucket; the outermost buckets, where clamped values
    pile up, and excluded firms are split by the ids' first characters, which keeps the
    order. The firms are dealt out by group once: the groups' counts and the places
    are both taken from that one exchange, so the plan before it runs once.
    """
    by = ["metric", *(population or ["sector", "period"])]
    kinds = dict(metrics.dtypes)
    names = [f"_k{i}" for i in range(len(by))]
    key = [*names, "bucket", "incl", "_g"]
    split = F.when((F.col("incl") == 0) | F.col("bucket").isin(0, buckets - 1), F.substring("entity_id", 1, prefix)).otherwise(F.lit(""))
    dealt = metrics.withColumns({"_g": split, **{n: F.coalesce(F.col(c), F.lit(-(2**31) if kinds[c] == "int" else "-").cast(kinds[c])) for n, c in zip(names, by, strict=True)}}).repartition(*key)
    whole = F.xxhash64(*dealt.columns)  # the count reads all columns, so that both readers want the same exchange
    counts = dealt.groupBy(*key).agg(F.count_if((whole >= 0) | (whole < 0)).alias("_n"))
    own = F.when(F.col("incl") == 1, F.col("_n")).otherwise(0)
    cell = Window.partitionBy(*names)
    up = cell.orderBy("incl", "bucket", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*(F.col(c).alias(f"o{c}") for c in key), (F.sum(own).over(up) - own).alias("_below"), F.sum(own).over(cell).cast("long").alias("n_valid"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("entity_id")) - 1)
    same = functools.reduce(operator.and_, (F.col(c) == F.col(f"o{c}") for c in key))
    rank = F.when(F.col("incl") == 1, F.col("_below") + F.col("_place")).otherwise(0).cast("long")
    return placed.join(offsets, same).select(*metrics.columns, rank.alias("rank"), "n_valid", F.when(F.col("incl") == 1, rank.cast("double") / F.greatest(F.col("n_valid") - 1, F.lit(1)).cast("double")).otherwise(0.0).alias("score"))


def composite(ranked: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Per firm: core metrics available, the strict score (all there) and the renormalised one (any there)."""
    of = lambda m, c: F.max(F.when((F.col("metric") == m) & (F.col("incl") == 1), c))
    wide = ranked.where(F.col("metric").isin(list(weights))).groupBy("entity_id", "period", "sector").agg(*(of(m, F.col("score")).alias(m) for m in weights))
    available = sum((F.col(m).isNotNull().cast("long") for m in CORE), F.lit(0).cast("long"))
    weighted = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    return wide.select("entity_id", "period", "sector", available.alias("core_available"), F.when(available == len(CORE), weighted).alias("strict"), F.when(available >= 1, weighted / weight).alias("renorm"))


def segmented_sum(rows: DataFrame, part: list[str], order: list[str], boundary: Column, value: Column) -> DataFrame:
    """Inclusive running sum that starts anew where the boundary holds."""
    up = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("segment", F.sum(boundary.cast("long")).over(up))
    inside = Window.partitionBy(*part, "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("running", F.sum(value).over(inside))


def run_edges(rows: DataFrame, part: list[str], key: str, order: list[str]) -> DataFrame:
    """Marks the first and the last row of each run of equal keys."""
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumns({"run_start": (~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int"), "run_end": (~F.col(key).eqNullSafe(F.lead(key).over(w)) | F.lead(F.lit(1)).over(w).isNull()).cast("int")})
