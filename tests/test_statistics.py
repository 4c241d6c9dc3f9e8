from datetime import date
from fractions import Fraction

import pytest
from helpers import entry, ledger
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import calendar as cal
from ledgerloom.functions import stats
from ledgerloom.functions.text import is_transposition
from ledgerloom.operators import aging, benford, card, drift, periods, profile, sampling
from ledgerloom.operators import rules as R


def test_wilson_and_decide():
    assert round(stats.z_value(), 6) == 1.959964
    assert [round(x, 4) for x in stats.wilson_interval(1, 8)] == [0.0224, 0.4709]
    assert stats.wilson_interval(0, 0) == (0, 1)
    assert stats.wilson_interval(0, 20)[1] == pytest.approx(3.8415 / 23.8415, abs=1e-4)
    for k, n, t, d, out in ((1, 1000, 0.05, stats.LOWER, "pass"), (300, 1000, 0.05, stats.LOWER, "exception"), (3, 60, 0.05, stats.LOWER, "inconclusive"), (98, 100, 0.9, stats.HIGHER, "pass"), (10, 100, 0.9, stats.HIGHER, "exception"), (5, 5, 0.9, stats.HIGHER, "inconclusive"), (1, 22, 0, stats.LOWER, "exception"), (0, 22, 0, stats.LOWER, "pass"), (0, 8, 0, stats.LOWER, "inconclusive"), (0, 0, 0.5, stats.HIGHER, "inconclusive")):
        assert stats.decide(stats.proportion("x", k, n, d), t).outcome == out
    with pytest.raises(ValueError):
        stats.decide(stats.proportion("x", 1, 2), 0.5)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60))
def test_wilson_holds_the_value(k, n):
    if k <= n and n:
        lo, hi = stats.wilson_interval(k, n)
        assert 0 <= lo <= k / n <= hi <= 1


def test_wilson_columns_agree(spark):
    rows = [(k, n) for n in (0, 1, 8, 60) for k in range(0, n + 1, max(1, n // 4))]
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    for r in spark.createDataFrame(rows, "k int, n int").select("k", "n", lo.alias("lo"), hi.alias("hi")).collect():
        assert (r["lo"], r["hi"]) == pytest.approx(stats.wilson_interval(r["k"], r["n"]), abs=1e-12)


def test_distributions():
    for x, df, p in ((3.841459, 1, 0.05), (15.50731, 8, 0.05), (16.91898, 9, 0.05), (20.09024, 8, 0.01)):
        assert stats.chi_square_sf(x, df) == pytest.approx(p, abs=1e-6)
    assert stats.binom_cdf(2, 5, 0.5) == pytest.approx(0.5)
    assert stats.hypergeom_cdf(1, 10, 3, 4) == pytest.approx(float(Fraction(35 + 3 * 35, 210)))


def test_sampling():
    assert [(s.n, s.allowed) for s in (sampling.attribute_sample_size(0.05, 0.05), sampling.attribute_sample_size(0.1, 0.1), sampling.attribute_sample_size(0.05, 0.05, 0.01))] == [(59, 0), (22, 0), (93, 1)]
    assert [sampling.evaluate_attribute_sample(60, k, 0.05, 0.05).outcome for k in (0, 5, 1)] == ["pass", "exception", "inconclusive"]
    assert sampling.upper_deviation_limit(10, 10, 0.05) == 1.0


def test_calendar(spark):
    assert len(cal.federal_holidays(2025)) == 11 and date(2025, 11, 27) in cal.federal_holidays(2025)
    assert date(2026, 7, 3) in cal.observed_holidays(2026) and date(2027, 12, 31) in cal.holidays_between(date(2027, 12, 1), date(2027, 12, 31))
    held = cal.holidays_between(date(2025, 1, 1), date(2025, 12, 31))
    assert len(cal.business_days(date(2025, 1, 1), date(2025, 1, 31), held)) == 21
    assert [d.day for d in cal.last_n_business_days(date(2025, 12, 31), 5, held)] == [24, 26, 29, 30, 31]
    assert cal.add_business_days(date(2025, 1, 1), 0, held) == date(2025, 1, 1)
    with pytest.raises(ValueError):
        cal.nth_weekday(2025, 2, 0, 5)
    assert cal.calendar(spark, date(2025, 1, 1), date(2025, 1, 31)).agg(F.max("ordinal")).first()[0] == 21


@pytest.mark.parametrize("a, b, yes", [("INV-1234", "INV-2134", True), ("1234", "4231", True), ("INV-1234", "INV-1235", False), ("1234", "5634", False), ("AB12", "BA12", False), ("123", "1234", False), ("12", "12", False)])
def test_transposition(spark, a, b, yes):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(is_transposition(F.col("a"), F.col("b"))).first()[0] is yes


def test_benford(spark):
    good = spark.range(2000).select(F.floor(F.pow(F.lit(10.0), 2 + F.col("id") / 500)).cast("bigint").alias("v"))
    t = benford.digit_test(good, "v", 1)
    assert t.applicable and t.outcome == "conforming" and benford.digit_test(good, "v", 2).applicable
    flat = spark.range(3000).select((10_000 + F.col("id") * 3330).alias("v"))
    assert benford.digit_test(flat, "v", 1).outcome == "nonconforming"
    for df, word in ((good.limit(50), "fewer"), (spark.range(1000).select((50_000 + F.col("id") * 10).alias("v")), "orders of magnitude"), (good.limit(1600).unionByName(spark.range(400).select(F.lit(250_000).cast("bigint").alias("v"))), "assigned")):
        t = benford.digit_test(df, "v", 1)
        assert not t.applicable and word in t.reason and t.p_value is None


def test_profile(spark):
    d = {r["q"]: r["value"] for r in profile.deciles(spark.range(1, 12).select(F.col("id").alias("v")), "v").collect()}
    assert (d[0], d[5], d[10], len(d)) == (1, 6, 11, 11)
    assert profile.deciles(spark.range(0).select(F.col("id").alias("v")), "v").count() == 0
    assert {r["value"] for r in profile.deciles(spark.createDataFrame([(7,)], "v long"), "v").collect()} == {7}
    book = ledger(spark, [entry(1), entry(2, source="AP"), entry(3, source="REV", approver=None), entry(4, approver=None)])
    s = profile.scalars(book).first()
    assert (s["n_lines"], s["requiring_approval"], s["missing_approval"]) == (8, 2, 1)
    cells = {(r["dimension"], r["category"]): r["k"] for r in profile.composition(book.entries).collect()}
    assert cells["by_source", "GL"] == 2 and cells["by_weekday", "6"] == 0 and sum(v for (d, _), v in cells.items() if d == "by_account") == 8


def test_periods_and_aging(spark):
    rows = [entry(1, posted="2025-01-10"), entry(2, posted="2025-01-11"), entry(3, posted="2025-02-10"), entry(4, posted="2025-04-01")]
    book = ledger(spark, rows)
    assert [(r["period"], r["n_entries"]) for r in periods.monthly_batches(book).collect()] == [("2025-01", 2), ("2025-02", 1), ("2025-04", 1)]
    assert periods.split_baseline(book, 2) == (["2025-01", "2025-02"], ["2025-04"])
    flags = spark.createDataFrame([("R-001", f"E-{i}") for i in range(1, 5)], "rule_id string, entry_id string")
    s = aging.age_exceptions(flags, book, "2025-03")
    assert s.n_not_yet_posted == 1 and s.by_rule().first().asDict() == {"rule_id": "R-001", "0": 0, "1": 1, "2": 2, "3+": 0}


def _months(spark, counts):
    """counts: {month: {preparer: n}}."""
    rows, n = [], 0
    for m, who in counts.items():
        for p, k in who.items():
            for _ in range(k):
                n += 1
                rows.append(entry(n, preparer=p, posted=f"{m}-10"))
    return ledger(spark, rows)


def test_drift(spark):
    p = drift.DriftParams(baseline_periods=1, dimensions=("by_preparer",))
    r = drift.analyze(_months(spark, {"2025-01": {"P-01": 120, "P-02": 80}, "2025-02": {"P-01": 30, "P-02": 70}}), p)
    got = {x["category"]: x for x in r.findings.collect()}
    assert got["P-01"]["shift"] < 0 < got["P-02"]["shift"]
    rule = drift.ProfileDrift(p)
    book = _months(spark, {"2025-01": {"P-01": 120, "P-02": 80}, "2025-02": {"P-01": 30, "P-02": 70}})
    assert rule.flags(book).count() == 70
    few = drift.analyze(_months(spark, {"2025-01": {"P-01": 150}, "2025-02": {"P-01": 10}}), p)
    assert few.untested and not few.tested
    assert not drift.analyze(_months(spark, {"2025-01": {"P-01": 20}, "2025-02": {"P-01": 40}}), p).applicable
    assert not drift.analyze(_months(spark, {"2025-01": {"P-01": 120}}), p).applicable
    with pytest.raises(ValueError):
        drift.DriftParams(dimensions=("by_account",))


def test_card(spark):
    m = spark.createDataFrame([(1, "a", "alpha", ["E-2"]), (1, "b", "beta", ["E-5"])], "seed int, anomaly_id string, anomaly_class string, entry_ids array<string>")
    f = spark.createDataFrame([(1, "F1", "E-2"), (1, "F1", "E-3"), (1, "F2", "E-4")], "seed int, rule_id string, entry_id string")

    class F1(R.Rule):
        rule_id, targets = "F1", ("alpha",)

    class F2(R.Rule):
        rule_id, targets = "F2", ("beta",)

    c = card.grade(spark.createDataFrame([(1, 5)], "seed int, n long"), m, f, [F1(), F2()], [1])
    assert c.recall["alpha"].measurement.numerator == 1 and c.recall["beta"].measurement.numerator == 0
    assert (c.precision.measurement.numerator, c.precision.measurement.n) == (1, 3)
    assert (c.fp_rate.measurement.numerator, c.fp_rate.measurement.n) == (2, 3)
    with pytest.raises(ValueError):
        card.build_report_card(spark, [1, 1], None)
