"""Nine gated ratio metrics per firm, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_index, exact_sum
from ..schema import CORE, METRICS, Metric


def terms(m: Metric, growth: bool = True) -> tuple[Column, Column, Column]:
    """Numerator, denominator and whether a firm is included, from the aligned columns."""
    present = F.lit(True)
    for s in m.sources:
        present = present & (F.col(f"has_{s}") == 1)
    if m.den is None:
        num = F.col("g_debt") - F.col("g_income") if growth else F.lit(None).cast("long")
        den, ok = F.lit(1).cast("long"), present & num.isNotNull()
    else:
        num, den = F.col(m.num), F.col(m.den)
        ok = present & num.isNotNull() & den.between(1, m.den_max)
    return num, den, F.coalesce(ok, F.lit(False))


def entity_metrics(aligned: DataFrame, growth: bool = True, buckets: bool = True) -> DataFrame:
    """entity_id, period, sector, metric, num, den, incl and, if asked for, bucket: nine rows a firm. num and den are null unless included."""
    rows = []
    for m in METRICS:
        num, den, ok = terms(m, growth)
        fields = [F.lit(m.name).alias("metric"), F.when(ok, num).alias("num"), F.when(ok, den).alias("den"), ok.cast("int").alias("incl")]
        if buckets:
            shown = F.greatest(num, F.lit(0)) if m.den is None else num  # a negative gap counts as the lowest bucket
            fields.append(bucket_index(shown, den, m.scale, m.edges, ok).alias("bucket"))
        rows.append(F.struct(*fields))
    return aligned.select("entity_id", "period", "sector", F.explode(F.array(*rows)).alias("m")).select("entity_id", "period", "sector", "m.*")


def coverage(metrics: DataFrame) -> DataFrame:
    """Per firm: core metrics available, and the strict and renormalised inclusion."""
    core = F.sum(F.when(F.col("metric").isin(CORE), F.col("incl")).otherwise(0))
    return metrics.groupBy("entity_id", "period").agg(core.alias("core_available")).withColumns({"incl_strict": (F.col("core_available") == len(CORE)).cast("int"), "incl_renorm": (F.col("core_available") >= 1).cast("int")})


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of numerators and denominators and the number of included firms, per metric and the given columns; all-excluded cells stay with zeros.

    rows: metrics in long form, or aligned rows, whose nine metrics are added up side
    by side in one pass; only the sums become rows.
    """
    if "metric" in rows.columns:
        return rows.groupBy(*by, "metric").agg(exact_sum(F.col("num")).alias("sum_num"), exact_sum(F.col("den")).alias("sum_den"), F.sum("incl").alias("n_valid"))
    sums = []
    for m in METRICS:
        num, den, ok = terms(m)
        sums += [exact_sum(F.when(ok, num)).alias(f"n_{m.name}"), exact_sum(F.when(ok, den)).alias(f"d_{m.name}"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).cast("long").alias(f"i_{m.name}")]
    wide = rows.groupBy(*by).agg(*sums)
    cells = F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(f"n_{m.name}").alias("sum_num"), F.col(f"d_{m.name}").alias("sum_den"), F.col(f"i_{m.name}").alias("n_valid")) for m in METRICS))
    return wide.select(*by, F.explode(cells).alias("m")).select(*by, "m.*")


def inclusion_audit(rows: DataFrame) -> DataFrame:
    """rows as for totals."""
    if "metric" in rows.columns:
        return rows.groupBy("metric").agg(F.sum("incl").alias("included"), F.sum(1 - F.col("incl")).alias("live_but_excluded"))
    counts = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(terms(m)[2].cast("long")), F.lit(0)).alias(m.name) for m in METRICS))
    return counts.select("n", F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), F.col(m.name).alias("included")) for m in METRICS))).alias("m")).select("m.metric", "m.included", (F.col("n") - F.col("m.included")).alias("live_but_excluded"))
