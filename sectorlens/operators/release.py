"""Disclosure control and release of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import WIDE, ratio, uniform_from
from ..schema import CORE
from ..session import durable
from .aggregate import CELL, QUANTILES, by_bucket, cells_with_percentiles, dense_histogram, histogram, reconcile, sector_ratios, target
from .align import alignment_audit
from .privacy import RhoBudget, gaussian, sigma

def clip_contributions(metrics: DataFrame, num_max: int, den_max: int) -> DataFrame:
    """Bounds what one firm adds to a sum; sensitivities hold only after it."""
    bound = lambda c, m: F.greatest(F.least(F.col(c), F.lit(m)), F.lit(-m)).cast("long")
    return metrics.withColumns({"num": F.when(F.col("num").isNotNull(), bound("num", num_max)), "den": F.when(F.col("den").isNotNull(), bound("den", den_max))})


def kanon_gate(cells: DataFrame, k: int = 5, *kept: str) -> DataFrame:
    """Cells of fewer than k firms stay as rows of zeros. k under 1 counts as 1. Other columns go, but for those named."""
    passed = F.col("n_valid") >= max(1, k)
    zero = F.lit(0)
    return cells.select(*CELL, passed.cast("int").alias("released"), *(F.when(passed, F.col(c)).otherwise(zero.cast(WIDE)).cast(WIDE).alias(c) for c in ("sum_num", "sum_den")), F.when(passed, F.col("n_valid")).otherwise(zero).cast("long").alias("n_valid"), F.when(passed, ratio(F.col("sum_num"), F.col("sum_den"))).alias("ratio"), *kept)


def exact_release(metrics: DataFrame, k: int = 5) -> DataFrame:
    """Gated cells with percentiles, from one aggregate by bucket: deterministic, no noise. Labelled apart from the private release."""
    cells = cells_with_percentiles(by_bucket(metrics))
    gated = kanon_gate(cells.select("*", F.struct(*(f"p{q}" for q in QUANTILES)).alias("_p")), k, "_p")
    return gated.select(*(c for c in gated.columns if c != "_p"), *(F.when(F.col("released") == 1, F.col(f"_p.p{q}")).otherwise(0).alias(f"p{q}") for q in QUANTILES))


def seeded_gaussian(s: float, *key: Column | str) -> Column:
    """Rounded Gaussian as a function of its key. Reproducible, for tests: NOT private."""
    u, v = uniform_from("u", *key), uniform_from("v", *key)
    return F.round(F.lit(s) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)).cast("long")


def seeded_histogram_noise(dense: DataFrame, rho: float, seed: str) -> DataFrame:
    """Every bin of every given cell noised and clamped at 0, reproducibly. NOT private."""
    key = F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in CELL))
    s = sigma(math.sqrt(2), rho)
    return dense.withColumn("hist", F.transform("hist", lambda x, i: F.greatest(F.lit(0).cast("long"), x + seeded_gaussian(s, key, i.cast("string")))))


def cover_firms(cells: DataFrame, k_min: int, k_max: int, seed: str) -> DataFrame:
    """n_valid raised by a triangular number of cover firms; sums unchanged. Reproducible."""
    half = (k_max - k_min) // 2 + 1
    key = F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in CELL))
    extra = sum((F.floor(uniform_from(x, key) * half) for x in ("u1", "u2")), F.lit(k_min))
    return cells.withColumn("n_covered", (F.col("n_valid") + extra).cast("long"))


@dataclass(frozen=True)
class NoisyThreshold:
    k: int = 5
    rho_threshold: float = 0.05
    rho_num: float = 0.1
    rho_den: float = 0.1
    rho_hist: float = 0.1
    delta: float = 1e-6
    num_max: int = 10**12
    den_max: int = 10**12

    @property
    def tau(self) -> float:
        return sigma(1, self.rho_threshold) * math.sqrt(2 * math.log(1 / (2 * self.delta)))


def noisy_threshold(metrics: DataFrame, p: NoisyThreshold, budget: RhoBudget, by_period: bool = True) -> DataFrame:
    """The private release: noised counts, sums and histograms, and percentiles of the clamped histogram.

    Noise is drawn in the executors, from the system's randomness, and kept in written
    tables, so that no cell is ever drawn twice. Each share of the budget is charged
    before its noise is drawn: first the threshold's, then, for groups with a cell that
    passed, that of sums and histogram. Sectors of one period hold different firms, so
    a (period, metric) pair is charged once, for the dearest of its cells. A cell whose
    noisy count is under k + tau is suppressed.
    """
    spark = metrics.sparkSession
    clipped = clip_contributions(metrics, p.num_max, p.den_max)
    cells = dense_histogram(histogram(clipped), sector_ratios(clipped).select(*CELL, "sum_num", "sum_den", "n_valid"))
    group = ["period", "metric"] if by_period else list(CELL)
    groups = lambda df: df.select(*group).distinct().count()
    rest = p.rho_num + p.rho_den + p.rho_hist
    budget.charge(p.rho_threshold * groups(cells))
    s_n, s_num, s_den, s_hist = sigma(1, p.rho_threshold), sigma(p.num_max, p.rho_num), sigma(p.den_max, p.rho_den), sigma(math.sqrt(2), p.rho_hist)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(noisy=[n + gaussian(s_n) for n in x["n_valid"]])

    counted = durable(cells.mapInPandas(count, T.StructType([*cells.schema.fields, T.StructField("noisy", T.LongType())])))
    passed = F.col("noisy") >= p.k + p.tau
    budget.charge(rest * groups(counted.where(passed)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(sum_num=[Decimal(max(0, int(v) + gaussian(s_num))) for v in x["sum_num"]], sum_den=[Decimal(max(0, int(v) + gaussian(s_den))) for v in x["sum_den"]], hist=[[max(0, int(v) + gaussian(s_hist)) for v in h] for h in x["hist"]])

    drawn = durable(counted.where(passed).mapInPandas(draw, counted.schema))
    shown = [*CELL, F.lit(True).alias("released"), *(F.col(c).cast(WIDE).alias(c) for c in ("sum_num", "sum_den")), F.greatest(F.col("noisy"), F.lit(0)).alias("n_valid"), ratio(F.col("sum_num"), F.col("sum_den")).alias("ratio"), "hist", *(f"p{q}" for q in QUANTILES)]
    zero, none = F.lit(0), F.lit(None)
    hidden = [*CELL, F.lit(False).alias("released"), *(zero.cast(WIDE).alias(c) for c in ("sum_num", "sum_den")), zero.cast("long").alias("n_valid"), none.cast("double").alias("ratio"), none.cast("array<long>").alias("hist"), *(none.cast("int").alias(f"p{q}") for q in QUANTILES)]
    return with_percentiles(drawn).select(*shown).unionByName(counted.where(~passed).select(*hidden))


def with_percentiles(cells: DataFrame) -> DataFrame:
    """cells plus the percentile buckets of the dense histogram `hist` by its own cumulated counts, 0 if it is empty, and its total as `_total`."""
    added = F.aggregate("hist", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x)))
    summed = cells.withColumn("_sums", added).withColumn("_total", F.coalesce(F.try_element_at("_sums", F.lit(-1)), F.lit(0).cast("long")))
    summed = summed.withColumns({f"_t{q}": target(q, F.col("_total")) for q in QUANTILES})
    first = lambda goal: F.size(F.filter("_sums", lambda c: c < goal))
    found = summed.withColumns({f"p{q}": F.when(F.col("_total") > 0, first(F.col(f"_t{q}"))).otherwise(0).cast("int") for q in QUANTILES})
    return found.drop("_sums", *(f"_t{q}" for q in QUANTILES))


def noisy_release_seeded(metrics: DataFrame, rho: float, seed: str) -> DataFrame:
    """Cells whose histograms are noised and clamped reproducibly, n_valid as the clamped total and percentiles from it. For tests: NOT private."""
    cells = sector_ratios(metrics).select(*CELL, "ratio", F.col("incl").alias("ratio_incl"))
    noised = seeded_histogram_noise(dense_histogram(histogram(metrics), cells), rho, seed)
    return with_percentiles(noised).select(*CELL, "ratio", "ratio_incl", "hist", F.col("_total").alias("n_valid"), *(f"p{q}" for q in QUANTILES))


def release_json(released: DataFrame) -> DataFrame:
    return released.select(F.to_json(F.struct(*released.columns)).alias("row"))


def from_release_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(F.from_json("row", schema).alias("r")).select("r.*")


def release_audit(released: DataFrame) -> DataFrame:
    """No negative counts, suppressed rows empty, percentiles rising."""
    ps = [c for c in released.columns if c[0] == "p" and c[1:].isdigit()]
    rising = F.lit(True)
    for a, b in zip(ps, ps[1:], strict=False):
        rising = rising & (F.coalesce(F.col(a), F.lit(0)) <= F.coalesce(F.col(b), F.lit(0)))
    return released.agg(F.count("*").alias("cells"), F.sum("released").cast("long").alias("released"), F.sum((F.col("n_valid") < 0).cast("int")).cast("long").alias("negative"), F.sum(((F.col("released") == 0) & (F.col("n_valid") != 0)).cast("int")).cast("long").alias("leaking"), F.sum((~rising).cast("int")).cast("long").alias("falling"))


def pipeline_audit(aligned: DataFrame, metrics: DataFrame, noisy: DataFrame, released: DataFrame, budget: RhoBudget, delta: float = 1e-6) -> tuple[DataFrame, str]:
    """One row of checks over all phases, and the same as text: alignment, inclusion, totals, clamped histograms, release, epsilon."""
    a = alignment_audit(aligned).select(F.col("live").alias("aligned_rows"), (F.col("live") > 0).alias("alignment_ok"))
    core = F.col("metric").isin(CORE)
    i = metrics.agg(F.coalesce(F.sum(F.when(core, F.col("incl"))), F.lit(0)).alias("core_included"))
    t = reconcile(metrics).agg(F.coalesce(F.min("reconciled"), F.lit(1)).alias("x")).select((F.col("x") == 1).alias("totals_match"))
    below = F.exists("hist", lambda x: x < 0)
    n = noisy.agg(F.coalesce(F.max(below.cast("int")), F.lit(0)).alias("x")).select((F.col("x") == 0).alias("bins_not_negative"))
    r = release_audit(released).select(F.col("released").alias("cells_released"), ((F.col("negative") == 0) & (F.col("leaking") == 0) & (F.col("falling") == 0)).alias("release_ok"))
    row = a.crossJoin(i).crossJoin(t).crossJoin(n).crossJoin(r).withColumn("epsilon", F.lit(budget.epsilon(delta)))  # one row each
    row = row.withColumn("overall", F.col("alignment_ok") & F.col("totals_match") & F.col("bins_not_negative") & F.col("release_ok"))
    found = row.first().asDict()
    text = "\n".join(f"{name}: {'ok' if value is True else 'FAILED' if value is False else value}" for name, value in found.items())
    return row, text


def sums_to_n(hist: DataFrame, cells: DataFrame) -> DataFrame:
    """Per cell whether its histogram adds up to n_valid."""
    total = hist.groupBy(*CELL).agg(F.sum("cnt").alias("total"))
    return cells.join(total, CELL, "left").select(*CELL, "n_valid", (F.coalesce("total", F.lit(0)) == F.col("n_valid")).cast("int").alias("exact"))
