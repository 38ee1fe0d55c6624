"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .edges import linear_edges

PEPPER = "sector-panel"
WIDE = "decimal(38,0)"


def canonical_id(raw: Column, pepper: str = PEPPER, version: int = 1) -> Column:
    """SHA-256 of pepper, version and the id's letters and digits in lower case."""
    return F.sha2(F.concat(F.lit(f"{pepper}|{version}|"), F.lower(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))), 256)


def row_tag(entity: Column, period: Column, key: str, bin_bits: int = 13) -> tuple[Column, Column]:
    """Bin and key of a row: the leading bits of a keyed hash, and the next 60."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), entity, period.cast("string")), 256)
    bits = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.shiftrightunsigned(bits, 32 - bin_bits), F.conv(F.substring(digest, 9, 15), 16, 10).cast("long")


def bucket_index(num: Column, den: Column, scale: int, edges: Sequence[int], included: Column) -> Column:
    """The last edge with edge * den <= num * scale, within the buckets; 0 if excluded or den is not positive.

    With whole edges that is the last edge <= floor(num * scale / den): one 64-bit
    division, decimal only where num * scale would pass 64 bits. Even edges give the
    bucket in closed form; others start from the logarithm's guess, put right by
    comparing whole edges, or by a lookup where the edges were forced apart.
    """
    if edges[0] < 0:
        raise ValueError("edges must not be negative")
    num, last = num.cast("long"), len(edges) - 2
    den = F.when(den > 0, den.cast("long"))
    whole = F.call_function("div", num * scale, den)
    if scale > 1:
        whole = F.when(num <= (2**63 - 1) // scale, whole).otherwise(F.least(whole_division(num.cast("decimal(20,0)") * scale, den), F.lit(edges[-1]).cast("decimal(38,0)")).cast("long"))
    whole = F.greatest(F.least(F.when(num > 0, whole).otherwise(F.when(den.isNotNull(), 0)), F.lit(edges[-1])), F.lit(edges[0])).cast("long")
    if list(edges) == linear_edges(edges[0], edges[-1], last + 1):
        found = F.call_function("div", (whole - edges[0] + 1) * (last + 1) - 1, F.lit(edges[-1] - edges[0]).cast("long"))
    else:
        found = _logarithmic(whole, edges)
    return F.when(F.coalesce(included & (num.isNotNull()) & den.isNotNull(), F.lit(False)), F.least(found, F.lit(last))).otherwise(0).cast("int")


def _logarithmic(q: Column, edges: Sequence[int]) -> Column:
    """The last of rising edges that is at most q, for q between the first and the last edge."""
    b, span = len(edges) - 1, math.log(edges[-1] / edges[0])
    at = lambda x: math.log(x / edges[0]) * b / span
    # from this edge on, the guess is at most one off at every edge and just under the next, hence between them too
    even = max([0, *(i + 1 for i in range(b) if at(edges[i]) < i - 0.9 or at(edges[i + 1] - 1) > i + 1.9)])
    if edges[even] - edges[0] > 100_000:
        raise ValueError("edges are neither even nor logarithmic")
    place = F.least(F.greatest(F.floor(F.log(q / edges[0]) * (b / span)).cast("int"), F.lit(0)), F.lit(b - 1))
    table = F.lit(list(edges))
    found = place + (F.get(table, place + 1) <= q).cast("int") - (F.get(table, place) > q).cast("int")
    if not even:
        return found
    starts, low = list(edges[: even + 1]), []
    for i in range(even):
        low += [i] * (starts[i + 1] - starts[i])
    return F.when(q < edges[even], F.get(F.lit(low), (q - edges[0]).cast("int"))).otherwise(found)


def midpoint(bucket: Column, edges: Sequence[int]) -> Column:
    table = F.lit(list(edges))
    at = F.least(bucket, F.lit(len(edges) - 2))
    return (F.element_at(table, at + 1) + F.element_at(table, at + 2)) / F.lit(2.0)


def cents(x: Column) -> Column:
    """Hundredths of a double, half away from zero."""
    v = x * 100
    return F.when(v < 0, -F.floor(-v + 0.5)).otherwise(F.floor(v + 0.5))


def exact_sum(x: Column) -> Column:
    """Sum of longs as decimal(38,0), added up as two halves in 64 bits; 0 over no values. Up to 2^31 rows a group."""
    halves = F.sum(F.shiftright(x, 32)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(x.bitwiseAND(0xFFFFFFFF)).cast("decimal(20,0)")
    return F.coalesce(halves.cast(WIDE), F.lit(0).cast(WIDE)).cast(WIDE)


def ratio(num: Column, den: Column) -> Column:
    """True division of two exact sums; null if the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))


def whole_division(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative numbers, exact."""
    a, b = a.cast("decimal(38,0)"), b.cast("decimal(38,0)")
    return ((a - a % b) / b).cast("decimal(38,0)")


def fixed_point_ratio(x: Column, y: Column, z: Column, scale: int = 10**6) -> tuple[Column, Column]:
    """(x + y) * scale div z and a flag for z = 0, where the denominator counts as 1."""
    safe = F.when(z == 0, F.lit(1)).otherwise(z)
    return whole_division((x + y) * scale, safe).cast("long"), z == 0


def uniform_from(*parts: Column | str) -> Column:
    """A reproducible number in (0, 1) from a hash. For tests and synthetic data: it is not private."""
    digest = F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


FRACTION = 32


def fixed(x: Column, bits: int = FRACTION) -> Column:
    """A number in fixed point, cut towards minus infinity."""
    return F.floor(x * float(1 << bits)).cast("decimal(38,0)")


def fixed_multiply(a: Column, b: Column, bits: int = FRACTION) -> Column:
    """(a * b) >> bits of fixed-point numbers, exact within 38 digits."""
    return F.floor(a.cast("decimal(19,0)") * b.cast("decimal(19,0)") / F.lit(1 << bits).cast("decimal(20,0)")).cast("decimal(38,0)")


def reciprocal_holds(x: Column, y: Column, bits: int = FRACTION, tolerance: int = 1) -> Column:
    """Whether fixed-point y is the reciprocal of whole x: |x * y - 2^bits| within tolerance * x."""
    return F.abs(x.cast("decimal(19,0)") * y.cast("decimal(19,0)") - F.lit(1 << bits).cast("decimal(20,0)")) <= x.cast("decimal(19,0)") * tolerance


def newton_reciprocal(x: int, bits: int = FRACTION, most: int = 64) -> tuple[int, list[int]]:
    """floor(2^bits / x) by Newton's steps in whole numbers, and how far each step moved it: the report of its convergence."""
    y, moved = 1 << max(0, bits - x.bit_length()), []
    for _ in range(most):
        new = y + (y * ((1 << bits) - x * y) >> bits)
        moved.append(abs(new - y))
        if new == y:
            break
        y = new
    while x * (y + 1) <= 1 << bits:
        y += 1
    while x * y > 1 << bits:
        y -= 1
    return y, moved


def length_prefixed(*parts: Column) -> Column:
    """Strings joined so that no two different lists give one text: each after its length in bytes."""
    return F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts))
