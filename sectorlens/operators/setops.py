"""Multi-party set operations and table joins. A party's table has an `id` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform_from
from .privacy import EpsilonLedger, laplace


def _marked(parties: list[DataFrame]) -> DataFrame:
    """(id, mask): one row per id with the parties that hold it as bits. One shuffle however many parties."""
    rows = reduce(DataFrame.unionByName, (p.select("id", F.lit(1 << i).alias("bit")) for i, p in enumerate(parties)))
    return rows.where("id is not null").groupBy("id").agg(F.bit_or("bit").alias("mask"))


def intersection(parties: list[DataFrame]) -> DataFrame:
    return _marked(parties).where(F.col("mask") == (1 << len(parties)) - 1).select("id")


def union(parties: list[DataFrame]) -> DataFrame:
    return _marked(parties).select("id")


def membership(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Distinct ids of the first party with a flag whether all others hold them."""
    full = (1 << (len(others) + 1)) - 1
    return _marked([first, *others]).where(F.col("mask").bitwiseAND(1) == 1).select("id", (F.col("mask") == full).cast("int").alias("in_all"))


def cardinality(parties: list[DataFrame]) -> DataFrame:
    return intersection(parties).agg(F.count("*").alias("n"))


def cardinality_sum(parties: list[DataFrame], by: str | None = None) -> DataFrame:
    """Number of common ids and the sum of the values that every party but the first has for them (one value an id and party)."""
    rows = reduce(DataFrame.unionByName, (p.select("id", F.lit(1 << i).alias("bit"), (F.col("value") if i else F.lit(0)).cast("long").alias("value"), *([F.col(by)] if by else [])) for i, p in enumerate(parties)))
    per_id = rows.groupBy("id", *([by] if by else [])).agg(F.bit_or("bit").alias("mask"), F.sum("value").alias("value")).where(F.col("mask") == (1 << len(parties)) - 1)
    return per_id.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"))


def party_values(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    """Ids of the first party that all others hold, with the value that each of them has (one value an id and party)."""
    n = len(others)
    rows = first.select("id", F.lit(1).alias("bit"), F.lit(None).cast("long").alias("value"))
    for i, p in enumerate(others, 1):
        rows = rows.unionByName(p.select("id", F.lit(1 << i).alias("bit"), F.col("value").cast("long").alias("value")))
    held = rows.where("id is not null").groupBy("id").agg(F.bit_or("bit").alias("mask"), *(F.max(F.when(F.col("bit") == 1 << i, F.col("value"))).alias(f"value_{i + 1}") for i in range(1, n + 1)))
    return held.where(F.col("mask") == (1 << n + 1) - 1).drop("mask")


class TooFew(RuntimeError):
    """The intersection is under the threshold; the message doesn't tell its size."""


def require(parties: list[DataFrame], k: int) -> DataFrame:
    """The intersection, or an error if it has under k ids."""
    found = intersection(parties)
    if found.limit(k).count() < k:  # no more is counted than the threshold asks for
        raise TooFew(f"the intersection has fewer than {k} ids")
    return found


def noisy_cardinality(parties: list[DataFrame], epsilon: float) -> float:
    """Size of the intersection with Laplace noise from the system's randomness."""
    return cardinality(parties).first().n + laplace(1 / epsilon)


def seeded_noisy_cardinality(parties: list[DataFrame], epsilon: float, seed: str) -> DataFrame:
    """The same, reproducibly: NOT private."""
    u = uniform_from("laplace", seed) - 0.5
    return cardinality(parties).select((F.col("n") - F.signum(u) * F.log(1 - F.least(2 * F.abs(u), F.lit(0.999999))) / epsilon).alias("noisy"))


def subsampled(rows: DataFrame, q: float, seed: str, key: str = "id") -> DataFrame:
    """Poisson subsample: every id is in with probability q, by a hash of it, so that all its rows are."""
    return rows.where(uniform_from("sample", seed, F.col(key).cast("string")) < q)


def truncated(rows: DataFrame, k: int, order: str = "id") -> DataFrame:
    """The first k rows."""
    return rows.orderBy(order).limit(k)


def column_sums(rows: DataFrame) -> DataFrame:
    """Per column the sum of its values' hashes: equal before and after a shuffle that loses, adds or changes nothing."""
    part = lambda c: F.conv(F.substring(F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("\0")), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return rows.agg(*(F.coalesce(F.sum(part(c)), F.lit(0)).cast("decimal(38,0)").alias(c) for c in rows.columns))


def venn_cells(parties: list[DataFrame]) -> DataFrame:
    """Ids by the exact set of parties that hold them."""
    return _marked(parties).groupBy("mask").agg(F.count("*").alias("n"))


def zeta(cells: DataFrame, n_parties: int) -> DataFrame:
    """Per set of parties the ids that all of them hold: sums over supersets. At most 2^parties rows."""
    masks = cells.sparkSession.range(1, 1 << n_parties).select(F.col("id").cast("int").alias("b"))
    return masks.join(F.broadcast(cells), F.col("mask").bitwiseAND(F.col("b")) == F.col("b"), "left").groupBy("b").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(F.col("b").alias("mask"), "n")


def moebius(counts: DataFrame) -> DataFrame:
    """Exact cells from zeta counts by inclusion and exclusion."""
    a = counts.select(F.col("mask").alias("b"))
    sign = F.when((F.bit_count("mask") - F.bit_count("b")) % 2 == 0, 1).otherwise(-1)
    return a.join(F.broadcast(counts), F.col("mask").bitwiseAND(F.col("b")) == F.col("b")).groupBy("b").agg(F.sum(sign * F.col("n")).cast("long").alias("n")).select(F.col("b").alias("mask"), "n")


def identification_risk(cells: DataFrame) -> DataFrame:
    """1 / n per cell, and its size padded to the next power of two."""
    return cells.withColumns({"risk": F.when(F.col("n") > 0, 1.0 / F.col("n")), "padded": F.when(F.col("n") > 0, F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long")).otherwise(0)})


def two_party_join(a: DataFrame, b: DataFrame, order: str = "pos") -> DataFrame:
    """(payload_a, payload_b): the first row of each id in a, with every row of b that has the id."""
    first = a.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("rn = 1")
    return first.select("id", F.col("payload").alias("payload_a")).join(b.select("id", F.col("payload").alias("payload_b")), "id").select("payload_a", "payload_b")


def party_join(parties: list[DataFrame]) -> DataFrame:
    """Inner join of all parties on id; columns get the party's number as a suffix. Many rows an id give their product."""
    named = [p.select("id", *(F.col(c).alias(f"{c}_{i + 1}") for c in p.columns if c != "id")) for i, p in enumerate(parties)]
    return reduce(lambda x, y: x.join(y, "id"), named)


class TooManyRows(ValueError):
    pass


def over_cap(party: DataFrame, cap: int) -> DataFrame:
    return party.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > cap)


def table_join(parties: list[DataFrame], cap: int) -> DataFrame:
    """party_join, refused if an id has more than `cap` rows in a party; nothing is cut off."""
    for i, p in enumerate(parties):
        if over_cap(p, cap).limit(1).count():
            raise TooManyRows(f"party {i + 1} has more than {cap} rows for an id")
    return party_join(parties)


def pad_to(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """rows and as many random ids as bring their number to size."""
    have = rows.count()
    spark: SparkSession = rows.sparkSession
    extra = spark.range(max(0, size - have)).select(F.sha2(F.concat_ws("|", F.lit(f"pad{seed}"), F.col("id").cast("string")), 256).alias("id"))
    return rows.select(F.col("id").cast("string").alias("id")).unionByName(extra)


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    return rows.orderBy(F.rand(seed))


def guarded_aggregate(parties: list[DataFrame], epsilon: float, sensitivity: float, k: int, ledger: EpsilonLedger, scope: str) -> dict:
    """Noisy size and mean party sum of the intersection: budget first, the gate on the noisy size."""
    ledger.reserve(scope, 2 * epsilon)
    exact = cardinality_sum(parties).first()
    n, total = (exact.n, exact.total) if exact else (0, 0)
    noisy = round(n + laplace(1 / epsilon))
    if noisy < k:
        return {"released": False, "n": 0, "total": 0}
    return {"released": True, "n": noisy, "total": round(total // (len(parties) - 1) + laplace(sensitivity / epsilon))}
