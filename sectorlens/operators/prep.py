"""Local preparation: canonical ids, range checks, validity and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import canonical_id, whole_division


def prepare(rows: DataFrame, attributes: dict[str, int], *kept: str) -> DataFrame:
    """entity_id, period, sector, the columns named; per attribute its value (null unless valid), `_nm` (not missing) and `_ok` (valid); warnings."""
    columns, warnings = [], []
    for name, most in attributes.items():
        ok = F.coalesce(F.col(name).between(0, most), F.lit(False))
        columns += [F.when(ok, F.col(name)).alias(name), F.col(name).isNotNull().cast("int").alias(f"{name}_nm"), ok.cast("int").alias(f"{name}_ok")]
        warnings.append(F.when(F.col(name).isNull(), F.lit(f"{name}: missing")).when(~ok, F.lit(f"{name}: out of range")))
    return rows.select(canonical_id(F.col("raw_entity_id")).alias("entity_id"), "period", "sector", *kept, *columns, F.array_join(F.array_compact(F.array(*warnings)), "; ").alias("warnings"))


def duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows that repeat the key of an earlier row, in the given order."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("occurrence", F.row_number().over(w)).where("occurrence > 1")


class DuplicateEntity(ValueError):
    """A key occurs twice in one source; the message names no entity."""


def assert_unique(rows: DataFrame, key: list[str]) -> None:
    if rows.groupBy(*key).count().where("count > 1").limit(1).count():
        raise DuplicateEntity("a source holds an entity and period more than once")


def growth(rows: DataFrame, value: str, out: str, clip: int = 10_000) -> DataFrame:
    """Change against the quarter before in basis points, cut to whole points towards zero and clipped; null without a positive value there."""
    w = Window.partitionBy("entity_id").orderBy("period")
    quarter = F.expr("period div 10 * 4 + period % 10")
    before = F.when(quarter - F.lag(quarter).over(w) == 1, F.lag(value).over(w))
    delta = (F.col(value) - before) * 10_000
    whole = whole_division(F.abs(delta), before) * F.when(delta < 0, -1).otherwise(1)
    return rows.withColumn(out, F.when(before > 0, F.least(F.greatest(whole, F.lit(-clip)), F.lit(clip)).cast("long")))
