"""Noise, accountants, composition and what attackers and auditors measure. Randomness from the operating system."""

from __future__ import annotations

import fcntl
import json
import math
import os
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_system = random.SystemRandom()


def sigma(sensitivity: float, rho: float) -> float:
    """Standard deviation of Gaussian noise for zero-concentrated privacy rho."""
    return sensitivity / math.sqrt(2 * rho)


def epsilon(rho: float, delta: float) -> float:
    return rho + 2 * math.sqrt(rho * math.log(1 / delta))


def gaussian(s: float, draw: Callable[[], float] = _system.random) -> int:
    """Rounded Gaussian by Box and Muller."""
    u, v = 1.0 - draw(), draw()
    return round(s * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v))


def laplace(scale: float, draw: Callable[[], float] = _system.random) -> float:
    u = draw() - 0.5
    return -scale * math.copysign(math.log(1 - min(abs(2 * u), 0.999999)), u)


def cover(k_min: int, k_max: int, randint: Callable[[int, int], int] = _system.randint) -> int:
    """Added firms: k_min and two uniform halves of the width, so triangular between the bounds."""
    half = (k_max - k_min) // 2
    return k_min + randint(0, half) + randint(0, half)


def noise_report(draws: DataFrame, s: float, value: str = "value", tolerance: float = 0.2) -> DataFrame:
    """Mean, variance and distinct values of drawn noise against its target variance."""
    found = draws.agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count_distinct(value).alias("unique_values"))
    return found.withColumns({"target_variance": F.lit(s * s), "passes": F.abs(F.col("variance") - s * s) / (s * s) < tolerance})


def clipped_mean_step(rows: DataFrame, value: str, clip: float, noise: float) -> float:
    """One private averaging round for a column: gradients about the mean, clipped one by one, summed and noised; the mean moved by their average."""
    first = rows.agg(F.avg(value).alias("m"), F.count(value).alias("n")).first()
    if not first.n:
        return 0.0
    gradient = F.greatest(F.least(F.col(value) - first.m, F.lit(float(clip))), F.lit(-float(clip)))
    total = rows.agg(F.sum(gradient).alias("s")).first().s
    return first.m + (total + _system.gauss(0.0, noise * clip)) / first.n


def basic_composition(parts: list[tuple[float, float]]) -> tuple[float, float]:
    return sum(e for e, _ in parts), sum(d for _, d in parts)


def gaussian_rdp(noise: float, steps: int, delta: float) -> float:
    """Epsilon of composed Gaussian mechanisms (sensitivity 1) by Renyi orders."""
    return min(steps * a / (2 * noise**2) + math.log(1 / delta) / (a - 1) for a in (1 + x / 10 for x in range(1, 1000)))


def attack_report(trials: DataFrame) -> DataFrame:
    """Accuracy of guesses (columns member, guess), the advantage over a coin, and the epsilon that it shows."""
    accuracy = F.avg((F.col("member") == F.col("guess")).cast("double"))
    found = trials.agg(F.count("*").alias("trials"), accuracy.alias("accuracy")).withColumn("advantage", F.abs(F.col("accuracy") - 0.5))
    return found.withColumn("epsilon", F.when(F.col("advantage") >= 0.5, F.lit(999.0)).otherwise(F.log((0.5 + F.col("advantage")) / (0.5 - F.least(F.col("advantage"), F.lit(0.499999999))))))


def attacker_accuracy_bound(mu: float) -> float:
    """Best accuracy of telling neighbouring inputs apart under Gaussian privacy mu."""
    return 0.5 * (1 + math.erf(mu / 2 / math.sqrt(2)))


class BudgetExceeded(RuntimeError):
    pass


@dataclass
class RhoBudget:
    """Concentrated-privacy accountant; a charge beyond the cap is refused and changes nothing."""

    cap: float = math.inf
    spent: float = 0.0
    queries: int = 0
    log: list[float] = field(default_factory=list)

    def charge(self, rho: float) -> None:
        if self.spent + rho > self.cap + 1e-12:
            raise BudgetExceeded("the privacy budget would be exceeded")
        self.spent += rho
        self.queries += 1
        self.log.append(rho)

    def epsilon(self, delta: float) -> float:
        return epsilon(self.spent, delta)


class EpsilonLedger:
    """Epsilon budget by scope in one JSON file, changed under a file lock."""

    def __init__(self, path: str, cap: float, most_queries: int = 1_000_000):
        self.path, self.cap, self.most = path, cap, most_queries

    def _locked(self, change: Callable[[dict], dict]) -> dict:
        with open(self.path, "a+", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            text = f.read()
            state = change(json.loads(text) if text else {})
            f.seek(0)
            f.truncate()
            json.dump(state, f)
            f.flush()
            os.fsync(f.fileno())
        return state

    def reserve(self, scope: str, eps: float) -> None:
        def change(state: dict) -> dict:
            spent, n = state.get(scope, (0.0, 0))
            if spent + eps > self.cap + 1e-12 or n + 1 > self.most:
                self._refused = True
                return state
            self._refused = False
            return {**state, scope: (spent + eps, n + 1)}

        self._locked(change)
        if self._refused:
            raise BudgetExceeded("the privacy budget of this scope would be exceeded")

    def peek(self, scope: str) -> tuple[float, int]:
        spent, n = self._locked(lambda s: s).get(scope, (0.0, 0))
        return spent, n

    def reset(self, scope: str) -> None:
        self._locked(lambda s: {k: v for k, v in s.items() if k != scope})
