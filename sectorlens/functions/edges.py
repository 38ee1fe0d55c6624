"""Bucket edges, computed once in exact or high-precision arithmetic and used as constants on both sides of a comparison."""

from __future__ import annotations

from decimal import Decimal, getcontext


def linear_edges(low: int, high: int, buckets: int) -> list[int]:
    """low + floor(step * b); the last edge is high."""
    return [low + (high - low) * b // buckets for b in range(buckets)] + [high]


def log_edges(low: int, high: int, buckets: int) -> list[int]:
    """Evenly spaced logarithms, cut to integers and forced to rise by at least one."""
    getcontext().prec = 50
    first, span = Decimal(low).ln(), Decimal(high).ln() - Decimal(low).ln()
    out: list[int] = []
    for b in range(buckets):
        e = int((first + span * b / buckets).exp() + Decimal("1e-30"))
        out.append(max(e, out[-1] + 1) if out else e)
    return [*out, max(high, out[-1] + 1)]
