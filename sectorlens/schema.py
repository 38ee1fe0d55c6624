"""Schemas of the three sources and the registry of metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .functions.edges import linear_edges, log_edges

MONEY_MAX, COUNT_MAX, EVENT_MAX = 10**14, 10**7, 10**6

#: attribute -> largest valid value; the smallest is 0
LENDING = {"total_outstanding_debt": MONEY_MAX, "annual_debt_service": MONEY_MAX, "delinquent_loan_balance": MONEY_MAX, "nonperforming_loan_balance": MONEY_MAX, "unsecured_loan_balance": MONEY_MAX, "debt_due_within_12_months": MONEY_MAX}
INCOME = {"annual_income": MONEY_MAX, "revenue": MONEY_MAX, "operating_surplus": MONEY_MAX}
WORKFORCE = {"employment_count": COUNT_MAX, "labour_force_count": COUNT_MAX, "working_age_population": COUNT_MAX, "retrenchment_count": EVENT_MAX, "vacancy_count": EVENT_MAX, "unemployment_count": COUNT_MAX}
SOURCES = {"a": LENDING, "b": INCOME, "c": WORKFORCE}

KEYS = ["entity_id", "period"]


def source_schema(attributes: dict[str, int]) -> T.StructType:
    return T.StructType([T.StructField("raw_entity_id", T.StringType()), T.StructField("period", T.IntegerType()), T.StructField("sector", T.IntegerType()), *(T.StructField(a, T.LongType()) for a in attributes)])


@dataclass(frozen=True)
class Metric:
    """num / den, the sources it needs, whether the denominator's range is checked, and its buckets."""

    name: str
    num: str
    den: str | None
    sources: str
    den_max: int | None
    scale: int
    edges: tuple[int, ...]
    core: bool = False


BUCKETS = 128
_BP = tuple(linear_edges(0, 10_000, BUCKETS))
METRICS = (
    Metric("DTI", "total_outstanding_debt", "annual_income", "ab", MONEY_MAX, 10_000, _BP, True),
    Metric("DSI", "annual_debt_service", "annual_income", "ab", MONEY_MAX, 10_000, _BP, True),
    Metric("DEmp", "total_outstanding_debt", "employment_count", "ac", COUNT_MAX, 1, tuple(log_edges(1, 10**8, BUCKETS))),
    Metric("IPW", "annual_income", "employment_count", "bc", COUNT_MAX, 1, tuple(log_edges(1, 10**7, BUCKETS))),
    Metric("Delq", "delinquent_loan_balance", "total_outstanding_debt", "a", MONEY_MAX, 10_000, _BP, True),
    Metric("NPL", "nonperforming_loan_balance", "total_outstanding_debt", "a", MONEY_MAX, 10_000, _BP, True),
    Metric("UnsecShare", "unsecured_loan_balance", "total_outstanding_debt", "a", MONEY_MAX, 10_000, _BP),
    Metric("StDebtShare", "debt_due_within_12_months", "total_outstanding_debt", "a", MONEY_MAX, 10_000, _BP),
    Metric("Gap", "g_debt", None, "ab", None, 10_000, tuple(linear_edges(0, 20_000, BUCKETS))),
)
CORE = [m.name for m in METRICS if m.core]
WEIGHTS = {m: 0.25 for m in CORE}
