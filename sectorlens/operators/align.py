"""Three-way alignment of the sources on (entity, period)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, SOURCES
from .prep import assert_unique

GROWTH = {"a": "g_debt", "b": "g_income"}


def align(lending: DataFrame, income: DataFrame, workforce: DataFrame, check: bool = False) -> DataFrame:
    """One row for each (entity, period) of any source: presence, every payload column, the reconciled sector and its conflict flag.

    Correct if each source holds a key once; `check` verifies that with one more pass.
    """
    parts = []
    for s, frame in zip("abc", (lending, income, workforce), strict=True):
        if check:
            assert_unique(frame, KEYS)
        parts.append(frame.withColumns({f"has_{s}": F.lit(1), f"sector_{s}": F.col("sector")}))
    return merge(parts)


def merge(parts: list[DataFrame]) -> DataFrame:
    """align for frames that hold one source or several: each has has_x, sector_x and the payload of its sources, null where a source has no row.

    A union and one hash aggregate, so one shuffle for any number of sources.
    """
    columns, kept, long = [], [], None
    for s, attributes in SOURCES.items():
        payload = [*attributes, *([GROWTH[s]] if s in GROWTH and any(GROWTH[s] in p.columns for p in parts) else [])]
        columns += [f"has_{s}", f"sector_{s}", *payload]
        kept += payload
    for p in parts:
        part = p.select(*KEYS, *(c for c in columns if c in p.columns))
        long = part if long is None else long.unionByName(part, allowMissingColumns=True)
    wide = long.groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in columns))
    conflict = lambda x, y: F.coalesce(F.col(f"sector_{x}") != F.col(f"sector_{y}"), F.lit(False))
    return wide.select(
        *KEYS,
        F.coalesce("sector_a", "sector_b", "sector_c").alias("sector"),
        (conflict("a", "b") | conflict("a", "c") | conflict("b", "c")).cast("int").alias("sector_conflict"),
        *(F.coalesce(f"has_{s}", F.lit(0)).alias(f"has_{s}") for s in "abc"),
        *kept,
    )


def alignment_audit(aligned: DataFrame) -> DataFrame:
    return aligned.agg(F.count("*").alias("live"), *(F.sum(f"has_{s}").alias(f"with_{s}") for s in "abc"), F.sum(F.col("has_a") * F.col("has_b") * F.col("has_c")).alias("with_all"), F.sum("sector_conflict").cast("long").alias("conflicts"))
