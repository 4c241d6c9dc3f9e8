"""Intervals and three-way decisions, as Column builders and as driver-side scalars."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

PASS, EXCEPTION, INCONCLUSIVE = "pass", "exception", "inconclusive"
LOWER, HIGHER, NEUTRAL = "lower_is_better", "higher_is_better", "neutral"


def z_value(confidence: float = 0.95) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    return NormalDist().inv_cdf((1 + confidence) / 2)


def wilson_interval(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Wilson score interval of k out of n; no observations: the whole range."""
    if n < 0 or not 0 <= k <= n:
        raise ValueError(f"{k} out of {n} is no proportion")
    if not n:
        return 0.0, 1.0
    z2 = z_value(confidence) ** 2
    mid = (k + z2 / 2) / (n + z2)
    reach = math.sqrt(z2) * math.sqrt(k * (n - k) / n + z2 / 4) / (n + z2)
    return (0.0 if k == 0 else max(0.0, mid - reach)), (1.0 if k == n else min(1.0, mid + reach))


def wilson(k: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """(lower, upper) of the same interval as columns."""
    z2 = z_value(confidence) ** 2
    k, n = k.cast("double"), n.cast("double")
    mid = (k + F.lit(z2 / 2)) / (n + F.lit(z2))
    safe = F.when(n > 0, n).otherwise(1.0)
    reach = F.lit(math.sqrt(z2)) * F.sqrt(k * (n - k) / safe + F.lit(z2 / 4)) / (n + F.lit(z2))
    low = F.when(n == 0, 0.0).when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), mid - reach))
    high = F.when(n == 0, 1.0).when(k == n, 1.0).otherwise(F.least(F.lit(1.0), mid + reach))
    return low, high


def disjoint(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Intervals that do not even touch."""
    return (high_a < low_b) | (high_b < low_a)


@dataclass(frozen=True)
class Measurement:
    """A proportion that never goes without its n and interval."""

    name: str
    numerator: int
    n: int
    low: float
    high: float
    direction: str = NEUTRAL
    confidence: float = 0.95
    method: str = "wilson"

    def __post_init__(self):
        if self.n < 0 or not 0 <= self.numerator <= max(self.n, 0):
            raise ValueError("numerator and n do not fit")
        if not 0 <= self.low <= self.high <= 1:
            raise ValueError("the interval is not one")
        if self.n and not self.low - 1e-12 <= self.value <= self.high + 1e-12:
            raise ValueError("the interval misses the value")
        if self.direction not in (LOWER, HIGHER, NEUTRAL):
            raise ValueError(f"unknown direction {self.direction}")

    @property
    def value(self) -> float:
        return self.numerator / self.n if self.n else 0.0

    def render(self) -> str:
        if not self.n:
            return f"{self.name}: not tested (n=0)"
        return f"{self.name}: {self.numerator}/{self.n} = {self.value:.4f} ({self.low:.4f}-{self.high:.4f}, n={self.n}, {self.confidence:.0%} {self.method}, {self.numerator}/{self.n})"


def proportion(name: str, k: int, n: int, direction: str = NEUTRAL, confidence: float = 0.95) -> Measurement:
    return Measurement(name, k, n, *wilson_interval(k, n, confidence), direction, confidence)


@dataclass(frozen=True)
class Decision:
    outcome: str
    reason: str
    threshold: float
    measurement: Measurement


def decide(m: Measurement, threshold: float, min_sample: int = 20) -> Decision:
    """Judge the interval, not the point: all of it on the good side passes (given
    min_sample), all of it on the bad side is an exception, anything else is open."""
    if m.direction == NEUTRAL:
        raise ValueError("a neutral measurement has no good side")
    if not m.n:
        return Decision(INCONCLUSIVE, "nothing tested (n=0)", threshold, m)
    enough = m.n >= min_sample
    if m.direction == LOWER and threshold == 0:
        if m.numerator:
            return Decision(EXCEPTION, "zero tolerance, and at least one was seen", threshold, m)
        return Decision(PASS if enough else INCONCLUSIVE, f"none seen in n={m.n}" + ("" if enough else f", fewer than {min_sample}"), threshold, m)
    good = m.high <= threshold if m.direction == LOWER else m.low >= threshold
    bad = m.low > threshold if m.direction == LOWER else m.high < threshold
    if good:
        return Decision(PASS if enough else INCONCLUSIVE, "the interval lies on the good side" + ("" if enough else f", but n={m.n} is under {min_sample}"), threshold, m)
    if bad:
        return Decision(EXCEPTION, "the interval lies on the bad side", threshold, m)
    return Decision(INCONCLUSIVE, "the threshold is inside the interval", threshold, m)


def decision(k: Column, n: Column, low: Column, high: Column, direction: str, threshold: float, min_sample: int = 20) -> Column:
    """The outcome of decide() as a column."""
    if direction not in (LOWER, HIGHER):
        raise ValueError("a neutral measurement has no good side")
    enough = n >= min_sample
    passed = F.when(enough, PASS).otherwise(INCONCLUSIVE)
    out = F.when(n == 0, INCONCLUSIVE)
    if direction == LOWER and threshold == 0:
        return out.when(k > 0, EXCEPTION).otherwise(passed)
    if direction == LOWER:
        return out.when(high <= threshold, passed).when(low > threshold, EXCEPTION).otherwise(INCONCLUSIVE)
    return out.when(low >= threshold, passed).when(high < threshold, EXCEPTION).otherwise(INCONCLUSIVE)


# exact distributions, driver side


def binom_pmf(k: int, n: int, p: float) -> float:
    if not 0 <= k <= n:
        return 0.0
    if p in (0.0, 1.0):
        return float(k == (n if p else 0))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def binom_cdf(k: int, n: int, p: float) -> float:
    return min(1.0, math.fsum(binom_pmf(i, n, p) for i in range(0, min(k, n) + 1)))


def hypergeom_cdf(k: int, population: int, marked: int, drawn: int) -> float:
    """P(at most k marked among drawn), exact."""
    ways = sum(math.comb(marked, i) * math.comb(population - marked, drawn - i) for i in range(max(0, drawn - (population - marked)), min(k, marked, drawn) + 1))
    return ways / math.comb(population, drawn)


def hypergeom_pmf(k: int, population: int, marked: int, drawn: int) -> float:
    if k < 0 or k > drawn or k > marked or drawn - k > population - marked:
        return 0.0
    return math.comb(marked, k) * math.comb(population - marked, drawn - k) / math.comb(population, drawn)


def chi_square_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: the regularised incomplete gamma Q(df/2, x/2)."""
    if df < 1:
        raise ValueError("df is at least 1")
    return 1.0 if x <= 0 else regularized_gamma_q(df / 2, x / 2)


def regularized_gamma_q(a: float, x: float) -> float:
    if a <= 0 or x < 0:
        raise ValueError("a > 0 and x >= 0")
    if x == 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # ascending series of P
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    # continued fraction of Q, evaluated forwards with rescaled convergents
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 2000):
        an = i * (a - i)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * f
