"""Audit chain, metrics text, configuration. Driver-side: one writer."""

from __future__ import annotations

import fcntl
import hashlib
import json
import math
import os
from dataclasses import dataclass, fields

BOUNDS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


class AuditLog:
    """Append-only JSON lines; each link is the SHA-256 of the entry and the link before."""

    def __init__(self, path: str):
        self.path = path

    def entries(self) -> list[dict]:
        if not os.path.exists(self.path):
            return []
        with open(self.path, encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]

    @staticmethod
    def link(reason: str, context: str, at: int, before: str) -> str:
        return hashlib.sha256(json.dumps([reason, context, at, before]).encode()).hexdigest()

    def append(self, reason: str, context: str, at: int) -> str:
        """Under a file lock; only the end of the log is read."""
        with open(self.path, "a+b") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            size, tail, step = f.seek(0, os.SEEK_END), b"", 4096
            while size and tail.strip().count(b"\n") == 0 and len(tail) < size:
                f.seek(max(0, size - step))
                tail, step = f.read(), 2 * step
            last = tail.strip().rsplit(b"\n", 1)[-1]
            before = json.loads(last)["link"] if last else ""
            link = self.link(reason, context, at, before)
            f.write((json.dumps({"reason": reason, "context": context, "at": at, "before": before, "link": link}) + "\n").encode())
            f.flush()
            os.fsync(f.fileno())
        return link

    def verify(self) -> bool:
        before = ""
        for e in self.entries():
            if e["before"] != before or e["link"] != self.link(e["reason"], e["context"], e["at"], before):
                return False
            before = e["link"]
        return True


class MetricsText:
    """Counters, gauges and cumulative histograms in the Prometheus text format."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self.histograms: dict[str, list[float]] = {}

    def add(self, name: str, by: float = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + by

    def set(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def observe(self, name: str, value: float) -> None:
        self.histograms.setdefault(name, []).append(value)

    def render(self) -> str:
        out = []
        for kind, table in (("counter", self.counters), ("gauge", self.gauges)):
            for name, value in sorted(table.items()):
                out += [f"# TYPE {name} {kind}", f"{name} {value:g}"]
        for name, values in sorted(self.histograms.items()):
            out.append(f"# TYPE {name} histogram")
            out += [f'{name}_bucket{{le="{b:g}"}} {sum(v <= b for v in values)}' for b in BOUNDS]
            out += [f'{name}_bucket{{le="+Inf"}} {len(values)}', f"{name}_sum {sum(values):g}", f"{name}_count {len(values)}"]
        return "\n".join(out) + "\n"


def break_even_buckets(firms: int) -> float:
    """The number B of buckets with B / log2 B = log2(firms), from 2 to 10,000."""
    goal = math.log2(max(firms, 4))
    b = goal
    for _ in range(200):  # a fixed point of B = goal * log2 B, reached from below or above
        b = min(10_000.0, max(2.0, goal * math.log2(max(b, 2.0))))
    return b


@dataclass
class Config:
    """Settings of a release. Text form: `key = value` lines, # comments; unknown keys are ignored."""

    k_anonymity: int = 5
    cover_min: int = 3
    cover_max: int = 15
    buckets: int = 128
    rho_budget: float = 3.0
    rho_threshold: float = 0.05
    rho_num: float = 0.1
    rho_den: float = 0.1
    rho_hist: float = 0.1
    delta: float = 1e-6
    contribution_clip: int = 10**12
    bin_bits: int = 13
    tag_bits: int = 60
    bin_cap: int = 1024
    fraction_bits: int = 32
    guard_bits: int = 8
    sessions: int = 4
    soundness_bits: int = 40
    query_cap: int = 1_000_000
    field_bits: int = 128

    @classmethod
    def parse(cls, text: str) -> Config:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {}
        for n, line in enumerate(text.splitlines(), 1):
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, sep, value = line.partition("=")
            if not sep:
                raise ValueError(f"line {n}: no = sign")
            if key.strip() in kinds:
                found[key.strip()] = kinds[key.strip()](value.strip())
        return cls(**found)

    def problems(self) -> list[str]:
        one = max(self.rho_threshold, self.rho_num, self.rho_den, self.rho_hist)
        rules = [
            (min(self.rho_threshold, self.rho_num, self.rho_den, self.rho_hist) > 0 and one <= 1, "every rho must lie in (0, 1]"),
            (0 < self.rho_budget <= 10, "rho_budget must lie in (0, 10]"),
            (self.rho_threshold + self.rho_num + self.rho_den + self.rho_hist <= self.rho_budget, "one cell exceeds rho_budget"),
            (0 < self.delta < 1, "delta must lie in (0, 1)"),
            (self.contribution_clip > 0, "contribution_clip must be positive"),
            (self.k_anonymity >= 1, "k_anonymity must be at least 1"),
            (0 <= self.cover_min <= self.cover_max, "cover_min must not exceed cover_max"),
            (self.cover_max <= 10_000, "cover_max must not exceed 10000"),
            (1 <= self.bin_bits <= 24, "bin_bits must lie in [1, 24]"),
            (8 <= self.tag_bits <= 128, "tag_bits must lie in [8, 128]"),
            (0 < self.bin_cap <= 65_536, "bin_cap must lie in (0, 65536]"),
            (8 <= self.fraction_bits <= 96, "fraction_bits must lie in [8, 96]"),
            (0 < self.guard_bits <= 32, "guard_bits must lie in (0, 32]"),
            (0 < self.buckets <= 4096, "buckets must lie in (0, 4096]"),
            (self.buckets & (self.buckets - 1) == 0, "buckets must be a power of 2"),
            (0 < self.sessions <= 64, "sessions must lie in (0, 64]"),
        ]
        return [text for ok, text in rules if not ok]

    def warnings(self, firms: int = 10**6) -> list[str]:
        """Settings that are valid but don't go together."""
        even = break_even_buckets(firms)
        rules = [
            (self.delta <= 2.0**-self.soundness_bits, f"delta exceeds 2^-{self.soundness_bits}, the statistical soundness"),
            (even / 2 <= self.buckets <= 2 * even, f"buckets lie outside half to twice the break-even number, {even:.0f}"),
            (self.query_cap * self.sessions <= 10**8, "query_cap times sessions exceeds 10^8"),
            (2 * self.fraction_bits + 20 <= self.field_bits, "fraction_bits are close to half of field_bits: products may overflow"),
        ]
        return [text for ok, text in rules if not ok]

    def canonical(self) -> str:
        return "\n".join(f"{f.name}={getattr(self, f.name):.9f}" if isinstance(getattr(self, f.name), float) else f"{f.name}={getattr(self, f.name)}" for f in sorted(fields(self), key=lambda f: f.name))

    def digest(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()
