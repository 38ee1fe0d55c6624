"""Cells: ratios of sums, histograms, distribution functions and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import WIDE, exact_sum, midpoint, ratio
from ..schema import METRICS
from .metrics import totals

CELL = ["sector", "period", "metric"]
QUANTILES = (25, 50, 75, 90, 95, 99)


def sector_ratios(rows: DataFrame) -> DataFrame:
    """rows: metrics in long form, or aligned rows (see totals)."""
    return totals(rows, "sector", "period").withColumns({"incl": (F.col("n_valid") > 0).cast("int"), "ratio": ratio(F.col("sum_num"), F.col("sum_den"))})


def histogram(metrics: DataFrame) -> DataFrame:
    """Counts of included firms per cell and bucket; empty buckets have no row."""
    return metrics.where("incl = 1").groupBy(*CELL, "bucket").agg(F.count("*").alias("cnt"))


def by_bucket(metrics: DataFrame) -> DataFrame:
    """Sums and counts per cell and bucket; excluded firms count as rows of bucket 0 with nothing in them. What cells need, from one pass over the firms."""
    return metrics.groupBy(*CELL, "bucket").agg(exact_sum(F.col("num")).alias("sum_num"), exact_sum(F.col("den")).alias("sum_den"), F.sum("incl").alias("cnt"))


def cells_with_percentiles(buckets: DataFrame, quantiles: tuple[int, ...] = QUANTILES) -> DataFrame:
    """Per cell its sums, n_valid, ratio and percentiles, from by_bucket."""
    cells = cdf(buckets).groupBy(*CELL).agg(F.sum("sum_num").cast(WIDE).alias("sum_num"), F.sum("sum_den").cast(WIDE).alias("sum_den"), F.max("total").alias("n_valid"), *(F.min(F.when((F.col("cnt") > 0) & (F.col("cum") >= target(q, F.col("total"))), F.col("bucket"))).alias(f"p{q}") for q in quantiles))
    return cells.withColumns({"incl": (F.col("n_valid") > 0).cast("int"), "ratio": ratio(F.col("sum_num"), F.col("sum_den"))})


def dense_histogram(hist: DataFrame, cells: DataFrame, buckets: int = 128) -> DataFrame:
    """hist as one array of counts for each of the given cells, zeros included."""
    by_cell = hist.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0).cast("long")))
    return cells.join(by_cell, CELL, "left").withColumn("hist", grid).drop("m")


def cdf(hist: DataFrame) -> DataFrame:
    up = Window.partitionBy(*CELL).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumns({"cum": F.sum("cnt").over(up), "total": F.sum("cnt").over(Window.partitionBy(*CELL))})


def target(q: int, n: Column) -> Column:
    """max(1, ceil(q% of n)) in integers."""
    return F.greatest(F.lit(1).cast("long"), F.floor((n * q + 99) / 100))


def percentiles(hist: DataFrame, quantiles: tuple[int, ...] = QUANTILES) -> DataFrame:
    """The first bucket at which the cumulated count reaches each quantile's target."""
    return cdf(hist).groupBy(*CELL).agg(F.max("total").alias("n_valid"), *(F.min(F.when(F.col("cum") >= target(q, F.col("total")), F.col("bucket"))).alias(f"p{q}") for q in quantiles))


def interpolated(hist: DataFrame, q: int) -> DataFrame:
    """Quantile by linear interpolation within its bucket, in the metric's unit of edges."""
    goal = F.col("total") * F.lit(q / 100)
    hit = cdf(hist).where((F.col("cum") >= goal) & (F.col("cum") - F.col("cnt") < goal))
    value = F.lit(None).cast("double")
    for m in METRICS:
        e = F.lit(list(m.edges))
        low, high = F.element_at(e, F.col("bucket") + 1), F.element_at(e, F.col("bucket") + 2)
        value = F.when(F.col("metric") == m.name, low + (high - low) * ((goal - (F.col("cum") - F.col("cnt"))) / F.col("cnt"))).otherwise(value)
    return hit.select(*CELL, value.alias(f"q{q}"))


def bucket_midpoints(hist: DataFrame) -> DataFrame:
    value = F.lit(None).cast("double")
    for m in METRICS:
        value = F.when(F.col("metric") == m.name, midpoint(F.col("bucket"), m.edges)).otherwise(value)
    return hist.withColumn("midpoint", value)


def reconcile(rows: DataFrame) -> DataFrame:
    """Per metric whether the cells' totals equal the global ones; rows as for totals."""
    cells = totals(rows, "sector", "period").groupBy("metric").agg(*(F.sum(c).alias(f"cell_{c}") for c in ("sum_num", "sum_den", "n_valid")))
    same = (F.col("sum_num") == F.col("cell_sum_num")) & (F.col("sum_den") == F.col("cell_sum_den")) & (F.col("n_valid") == F.col("cell_n_valid"))
    return totals(rows).join(cells, "metric").select("metric", "n_valid", same.cast("int").alias("reconciled"))
