"""The three sources derived from the star schema's tables, and the plan from them to metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cents as hundredths
from ..operators.align import GROWTH, merge
from ..operators.metrics import entity_metrics
from ..operators.prep import growth, prepare
from ..schema import INCOME, LENDING, WORKFORCE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: str) -> Column:
    return hundredths(F.expr(x))


def _period() -> Column:
    return F.year("o_orderdate") * 10 + F.quarter("o_orderdate")


def _firms(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where(keep).select("c_custkey", F.col("c_name").alias("raw_entity_id"), "c_nationkey")


def raw_lending(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda when: F.coalesce(F.sum(F.when(F.expr(when), F.col("cents"))), F.lit(0)).cast("long")
    orders = table(spark, sf_dir, "orders").where("o_custkey % 10 <> 0").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate", _period().alias("period"), cents("o_totalprice").alias("cents"))
    sums = orders.groupBy("o_custkey", "period").agg(F.sum("cents").alias("total_outstanding_debt"), part("o_orderstatus = 'P'").alias("annual_debt_service"), part("o_orderstatus = 'F'").alias("delinquent_loan_balance"), part("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").alias("nonperforming_loan_balance"), part("o_orderpriority = '5-LOW'").alias("unsecured_loan_balance"), part("month(o_orderdate) % 3 = 0").alias("debt_due_within_12_months"))
    return sums.join(_firms(spark, sf_dir, "c_custkey % 10 <> 0"), F.col("o_custkey") == F.col("c_custkey")).select("raw_entity_id", "period", (F.col("c_nationkey") + 1).alias("sector"), *LENDING)


def _line_sums(spark: SparkSession, sf_dir: str, keep: str) -> DataFrame:
    """What income and workforce hold of a customer's lines in a quarter; columns that a reader doesn't ask for are not computed."""
    orders = table(spark, sf_dir, "orders").where(keep).select("o_orderkey", "o_custkey", _period().alias("period"))
    flag = lambda c, v: F.sum((F.col(c) == v).cast("long"))
    price = {"gross": "l_extendedprice", "revenue": "l_extendedprice * (1 - l_discount)", "operating_surplus": "l_extendedprice * l_discount"}
    sums = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "period").agg(*(F.sum(cents(x)).alias(name) for name, x in price.items()), F.sum(F.col("l_quantity").cast("long")).alias("employment_count"), F.count("*").alias("n"), flag("l_returnflag", "A").alias("retrenchment_count"), flag("l_returnflag", "R").alias("vacancy_count"), flag("l_linestatus", "O").alias("unemployment_count"))
    return sums.join(_firms(spark, sf_dir, keep.replace("o_custkey", "c_custkey")), F.col("o_custkey") == F.col("c_custkey"))


def _income() -> list[Column]:
    return [F.when(F.col("c_custkey") % 11 != 0, F.col("gross") * 4).alias("annual_income"), F.col("revenue"), F.col("operating_surplus")]


def _workforce() -> list[Column]:
    return [F.col("employment_count"), (F.col("employment_count") + F.col("n")).alias("labour_force_count"), (F.col("employment_count") + 3 * F.col("n")).alias("working_age_population"), F.col("retrenchment_count"), F.col("vacancy_count"), F.col("unemployment_count")]


def _sector(income: bool) -> Column:
    return F.col("c_nationkey") + 1 + ((F.col("c_custkey") % 17 == 0).cast("int") if income else 0)


HAS_B, HAS_C = "o_custkey % 7 <> 0", "o_custkey % 4 <> 0"


def raw_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_sums(spark, sf_dir, HAS_B).select("raw_entity_id", "period", _sector(True).alias("sector"), *_income())


def raw_workforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_sums(spark, sf_dir, HAS_C).select("raw_entity_id", "period", _sector(False).alias("sector"), *_workforce())


def lending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth(prepare(raw_lending(spark, sf_dir), LENDING), "total_outstanding_debt", GROWTH["a"])


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources on (entity, period). Income and workforce come from the same lines, which are read, joined and added up once for both."""
    lines = _line_sums(spark, sf_dir, f"({HAS_B} or {HAS_C})")
    b, c = F.expr(HAS_B), F.expr(HAS_C)
    raw = lines.select("raw_entity_id", "period", _sector(False).alias("sector"), b.cast("int").alias("has_b"), c.cast("int").alias("has_c"), F.when(b, _sector(True)).alias("sector_b"), F.when(c, _sector(False)).alias("sector_c"), *(F.when(b, x).alias(name) for name, x in zip(INCOME, _income(), strict=True)), *(F.when(c, x).alias(name) for name, x in zip(WORKFORCE, _workforce(), strict=True)))
    both = growth(prepare(raw, {**INCOME, **WORKFORCE}, "has_b", "has_c", "sector_b", "sector_c"), "annual_income", GROWTH["b"])
    a = lending(spark, sf_dir).withColumns({"has_a": F.lit(1), "sector_a": F.col("sector")})
    return merge([a, both])


def metrics(spark: SparkSession, sf_dir: str, buckets: bool = True) -> DataFrame:
    return entity_metrics(aligned(spark, sf_dir), buckets=buckets)
