"""Digit tests against Benford's law, with refusal where the test would mean nothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi_square_sf, wilson
from ..model import Ledger, enrich

#: Upper bounds of close, acceptable and marginal mean absolute deviation.
BANDS = {1: (0.006, 0.012, 0.015), 2: (0.008, 0.010, 0.012)}


def expected(place: int) -> dict[int, float]:
    if place == 1:
        return {d: math.log10(1 + 1 / d) for d in range(1, 10)}
    return {d: sum(math.log10(1 + 1 / (10 * a + d)) for a in range(1, 10)) for d in range(10)}


@dataclass(frozen=True)
class Benford:
    place: int
    n: int
    applicable: bool
    reason: str
    digits: list[dict] = field(default_factory=list)
    chi_square: float | None = None
    p_value: float | None = None
    mad: float | None = None
    band: str = ""
    outcome: str = "inconclusive"


def positive(values: DataFrame, column: str, place: int) -> DataFrame:
    c = F.col(column).cast("bigint")
    return values.select(c.alias("v")).where(c >= (1 if place == 1 else 10))


def digit_counts(values: DataFrame, column: str, place: int) -> DataFrame:
    """(digit, observed, n, share, low, high, expected_share) for every digit, seen or not."""
    p = positive(values, column, place)
    spark = values.sparkSession
    skeleton = spark.createDataFrame([(d, float(e)) for d, e in expected(place).items()], "digit int, expected_share double")
    seen = p.groupBy(F.substring(F.col("v").cast("string"), place, 1).cast("int").alias("digit")).agg(F.count("*").alias("observed"))
    t = skeleton.join(seen, "digit", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    total = p.agg(F.count("*").alias("n"))
    t = t.crossJoin(F.broadcast(total))  # nine or ten rows and one
    low, high = wilson(F.col("observed"), F.col("n"))
    return t.select("digit", "observed", "n", F.when(F.col("n") > 0, F.col("observed") / F.col("n")).otherwise(0.0).alias("share"), low.alias("low"), high.alias("high"), "expected_share")


def guard(values: DataFrame, column: str, place: int, min_n: int = 300, span_min: float = 100, max_mode_share: float = 0.05) -> tuple[int, str]:
    """n and why the test is refused ('' if it is not). Order: too few, not positive, too
    narrow, too concentrated."""
    p = positive(values, column, place)
    n, lo, hi = p.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if n < min_n:
        return n, f"{n} values are fewer than {min_n}"
    if lo <= 0:
        return n, "a value is not positive"
    if hi / lo < span_min:
        return n, f"the values span a factor of {hi / lo:.1f}, less than {span_min:g} (orders of magnitude)"
    mode = p.groupBy("v").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "v").first()
    if mode["k"] / n > max_mode_share:
        return n, f"the value {mode['v']} makes up {mode['k']}/{n} of the values, so they look assigned"
    return n, ""


def band_of(mad: float, place: int) -> tuple[str, str]:
    for limit, name in zip(BANDS[place], ("close", "acceptable", "marginal"), strict=True):
        if mad <= limit:
            return name, "inconclusive" if name == "marginal" else "conforming"
    return "nonconforming", "nonconforming"


def digit_test(values: DataFrame, column: str, place: int = 1, **limits) -> Benford:
    n, why = guard(values, column, place, **limits)
    if why:
        return Benford(place, n, False, why)
    rows = [r.asDict() for r in digit_counts(values, column, place).orderBy("digit").collect()]
    chi = sum((r["observed"] - n * r["expected_share"]) ** 2 / (n * r["expected_share"]) for r in rows)
    mad = sum(abs(r["share"] - r["expected_share"]) for r in rows) / len(rows)
    band, outcome = band_of(mad, place)
    return Benford(place, n, True, "", rows, chi, chi_square_sf(chi, len(rows) - 1), mad, band, outcome)


def summary(values: DataFrame, column: str, place: int) -> DataFrame:
    """One row (n, chi_square, mad) without leaving Spark."""
    t = digit_counts(values, column, place)
    e = F.col("n") * F.col("expected_share")
    return t.agg(F.max("n").alias("n"), F.sum((F.col("observed") - e) * (F.col("observed") - e) / F.when(e > 0, e)).alias("chi_square"), F.avg(F.abs(F.col("share") - F.col("expected_share"))).alias("mad"))


def benford_for_ledger(ledger: Ledger, **limits) -> tuple[Benford, Benford]:
    e = enrich(ledger.entries)
    return digit_test(e, "amount_cents", 1, **limits), digit_test(e, "amount_cents", 2, **limits)
