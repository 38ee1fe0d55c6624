"""Synthetic inputs, built from ranges and hashes: no driver data."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform_from


def firm_panel(spark: SparkSession, firms: int, sectors: int = 20, lending_share: float = 0.1, period: int = 20261, partitions: int | None = None) -> DataFrame:
    """Aligned rows: every firm has income and workforce data, a share has lending data, none has growth."""
    def number(tag: int, low: int, high: int):
        return (F.pmod(F.xxhash64(F.col("id"), F.lit(tag)), F.lit(high - low + 1)) + low).cast("long")

    lent = F.pmod(F.xxhash64(F.col("id"), F.lit(0)), F.lit(10_000)) < int(lending_share * 10_000)
    debt = number(1, 10**6, 10**9)
    part = lambda tag: (debt * number(tag, 0, 40) / 100).cast("long")
    only = lambda c: F.when(lent, c)
    return spark.range(0, firms, 1, partitions or spark.sparkContext.defaultParallelism).select(
        F.col("id").cast("string").alias("entity_id"), F.lit(period).alias("period"), (F.pmod(F.col("id"), F.lit(sectors)) + 1).cast("int").alias("sector"), F.lit(0).alias("sector_conflict"),
        lent.cast("int").alias("has_a"), F.lit(1).alias("has_b"), F.lit(1).alias("has_c"),
        only(debt).alias("total_outstanding_debt"), only(part(2)).alias("annual_debt_service"), only(part(3)).alias("delinquent_loan_balance"), only(part(4)).alias("nonperforming_loan_balance"), only(part(5)).alias("unsecured_loan_balance"), only(part(6)).alias("debt_due_within_12_months"), F.lit(None).cast("long").alias("g_debt"),
        number(7, 10**7, 10**10).alias("annual_income"), number(8, 10**7, 10**10).alias("revenue"), number(9, 0, 10**9).alias("operating_surplus"), F.lit(None).cast("long").alias("g_income"),
        number(10, 1, 1000).alias("employment_count"), number(11, 1, 2000).alias("labour_force_count"), number(12, 1, 3000).alias("working_age_population"), number(13, 0, 50).alias("retrenchment_count"), number(14, 0, 50).alias("vacancy_count"), number(15, 0, 100).alias("unemployment_count"),
    )


def party_set(spark: SparkSession, party: int, rows: int, shared: int, payloads: int = 1, rows_per_id: int = 1) -> DataFrame:
    """Ids 0..shared-1 are common to all parties, the others are the party's own."""
    base = spark.range(rows).select(F.when(F.col("id") < shared, F.concat(F.lit("common"), F.col("id"))).otherwise(F.concat(F.lit(f"own{party}_"), F.col("id"))).alias("id"), F.col("id").alias("k"))
    base = base.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows_per_id - 1))))
    return base.select("id", *(F.concat(F.lit(f"v{party}_"), F.col("k"), F.lit("_"), F.col("r"), F.lit(f"_b{w}")).alias(f"p{w + 1}") for w in range(payloads)))


def fixed_point_set(spark: SparkSession, party: int, rows: int, scale: int = 10**6) -> DataFrame:
    return spark.range(rows).select(F.col("id").cast("string").alias("id"), (F.floor(uniform_from(f"party{party}", F.col("id").cast("string")) * 1000 * scale)).cast("long").alias("value"))


def attack_trials(spark: SparkSession, trials: int, epsilon: float, count: int = 100, seed: str = "trial", subsample: float = 1.0) -> DataFrame:
    """Membership inference: per trial a coin decides whether the firm is a member, a subsample whether a member counts; the attacker sees a Laplace-noised count and guesses."""
    key = F.col("id").cast("string")
    coin = (uniform_from(seed, "coin", key) < 0.5).cast("int")
    counted = coin * (uniform_from(seed, "sample", key) < subsample).cast("int")
    u = uniform_from(seed, "noise", key) - 0.5
    noisy = F.lit(count) + counted - F.signum(u) * F.log(1 - F.least(2 * F.abs(u), F.lit(0.999999))) / epsilon
    return spark.range(trials).select("id", coin.alias("member"), noisy.alias("seen"), (noisy > count + 0.5 * subsample).cast("int").alias("guess"))


def noise_draws(spark: SparkSession, draws: int, s: float, seed: str = "noise") -> DataFrame:
    """Rounded Gaussian noise, reproducible: for reports on its quality, not for releases."""
    u, v = (uniform_from(x, seed, F.col("id").cast("string")) for x in "uv")
    return spark.range(draws).select("id", F.round(s * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)).cast("long").alias("value"))
