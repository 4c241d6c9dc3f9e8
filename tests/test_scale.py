"""What keeps a query's work in step with its input: plans, and results against plain code."""

import os
import random
from datetime import date, timedelta
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from helpers import entry, ledger
from pyspark.sql import functions as F

from ledgerloom.operators import aging, bands, drift, near, profile
from ledgerloom.operators import rules as R
from ledgerloom.plans import audit, views
from ledgerloom.plans import registry as plans

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_sides(spark):
    """Only joins with a hint are broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@tables
def test_parents_that_no_column_needs_are_not_read(spark):
    p = plan(plans.QUERIES["profile_deciles"](spark, SF))
    assert "o_orderkey" not in p and "p_partkey" not in p


@tables
def test_lines_go_through_one_exchange(spark, no_small_sides):
    """By bucket, for their numbers and their orders at once."""
    p = plan(plans.QUERIES["r002"](spark, SF))
    assert "hashpartitioning(l_orderkey" not in p and "hashpartitioning(l_partkey" not in p


@tables
@pytest.mark.parametrize("gone", ["orders", "part"])
def test_a_line_without_a_parent_is_no_entry(spark, tmp_path, gone):
    """Numbers are those of the lines that are left."""
    for name, key in (("lineitem", None), ("orders", "o_orderkey"), ("part", "p_partkey")):
        t = views.table(spark, SF, name)
        (t.where(f"{key} % 7 <> 3") if name == gone else t).write.parquet(str(tmp_path / f"{name}.parquet"))
    line, parent = ("l_orderkey", "o_orderkey") if gone == "orders" else ("l_partkey", "p_partkey")
    left = views.table(spark, str(tmp_path), "lineitem").join(views.table(spark, str(tmp_path), gone), F.col(line) == F.col(parent)).count()
    got = views.gl(spark, str(tmp_path)).entries.agg(F.count("*"), F.countDistinct("entry_seq"), F.min("entry_seq"), F.max("entry_seq")).first()
    assert tuple(got) == (left, left, 1, left)


@tables
def test_the_battery_keeps_flat_rows(spark):
    flags = audit.battery(spark, SF)
    kept = [line for line in flags._jdf.queryExecution().optimizedPlan().toString().splitlines() if "InMemoryRelation" in line]
    assert kept and not any("lines" in line for line in kept)
    spark.catalog.clearCache()


@pytest.mark.parametrize("window", [0, 3, 11, None])
def test_partners_of_rows(spark, window):
    rng = random.Random(5)
    rows = [(f"E{i:03d}", rng.choice(["x", "y", None]), None if i % 40 == 7 else date(2020, 1, 1) + timedelta(rng.randrange(-300, 300))) for i in range(240)]
    df = spark.createDataFrame(rows, "entry_id string, k string, day date")
    got = {r["entry_id"]: r["p"] for r in bands.with_near(df, ["k"], "day", window).select("entry_id", bands.partner_ids(F.col("near")).alias("p")).collect()}
    near_by = lambda a, b: window is None or (a is not None and b is not None and abs((a - b).days) <= window)
    assert got == {i: sorted(j for j, m, e in rows if j != i and k is not None and k == m and near_by(d, e)) for i, k, d in rows}


def test_pairs_are_not_shuffled(spark, no_small_sides):
    book = ledger(spark, [entry(n, posted=f"2025-06-{n:02d}") for n in range(1, 9)])
    for rule in (R.Duplicate(), R.NearDuplicate(), R.BelowThreshold()):
        p = plan(rule.flags(book).drop("rationale"))
        assert p.count("Exchange ") == 1 and "Join" not in p


def _brute(rows, window, tolerance, least):
    out = {}
    for x in rows:
        best = None
        for y in rows:
            lo, hi = sorted((x[3], y[3]))
            if x[0] == y[0] or x[1] != y[1] or abs(x[2] - y[2]) > window or lo == hi or (hi - lo) / lo > tolerance:
                continue
            a, b = (x, y) if (x[2], x[0]) < (y[2], y[0]) else (y, x)
            ok = x[5] == y[5] if x[5] and y[5] else x[4] != y[4] and SequenceMatcher(None, a[4], b[4]).ratio() >= least
            if ok and (best is None or (y[2], y[0]) < best):
                best = (y[2], y[0])
        if best:
            out[x[0]] = best[1]
    return out


def _rows(n):
    rng = random.Random(9)
    texts = ["red bolt", "red rod", "hot bolt", "old plate", "large ring", "larger ring 2"]
    return [(f"E{i:04d}", rng.choice("pq"), rng.randrange(120), rng.choice([1000, 1005, 1010, 1030, 5000, 5020, 5200, 90_000, 91_000]) + rng.randrange(8), rng.choice(texts), rng.choice(["", "", "123", "777"])) for i in range(n)]


@pytest.mark.parametrize("rows", [40, 100_000])
def test_first_near_partner(monkeypatch, rows):
    """Whatever the rows that are looked at together."""
    monkeypatch.setattr(near, "ROWS", rows)
    monkeypatch.setattr(near, "PAIRS", 50)
    data = sorted(_rows(400), key=lambda r: (r[1], r[3]))
    cols = list(zip(*data, strict=True))
    t = pa.table({"preparer_id": cols[1], "accounts": ["a"] * len(data), "__at": [0] * len(data), "__home": [True] * len(data), "entry_id": cols[0], "__d": pa.array(cols[2], pa.int32()), "amount_cents": cols[3], "description": cols[4], "tokens": cols[5]})
    out = near._First(["preparer_id", "accounts", "__at"], 9, 0.02, 0.6)(iter(t.to_batches(max_chunksize=23)))
    got = [r for b in out for r in b.to_pylist()]
    assert len(got) == len({r["entry_id"] for r in got})
    assert {r["entry_id"]: r["partner"] for r in got} == _brute(data, 9, 0.02, 0.6)


def test_amount_pairs(spark):
    data = _rows(300)
    df = spark.createDataFrame([(i, k, date(2020, 1, 1) + timedelta(d), a, t, [x] if x else []) for i, k, d, a, t, x in data], "entry_id string, preparer_id string, posting_date date, amount_cents long, description string, tokens array<string>")
    got = sorted((r["a_entry_id"], r["b_entry_id"]) for r in near.amount_pairs(df, ["preparer_id"], 9, 0.02).collect())
    ok = lambda x, y: x[1] == y[1] and (x[2], x[0]) < (y[2], y[0]) and y[2] - x[2] <= 9 and x[3] != y[3] and abs(x[3] - y[3]) / min(x[3], y[3]) <= 0.02
    assert got == sorted((x[0], y[0]) for x in data for y in data if ok(x, y))
    firsts = {r["entry_id"]: r["partner"] for r in near.first_near(df, ["preparer_id"], 9, 0.02, 0.6).collect()}
    assert firsts == _brute(data, 9, 0.02, 0.6)


def test_rare_pairs_go_to_the_rows(spark, no_small_sides):
    book = ledger(spark, [entry(n) for n in range(1, 4)])
    assert "SortMergeJoin" not in plan(R.RarePairing(1, 1).flags(book))


def test_grown_cells_go_to_the_rows(spark, no_small_sides):
    days = [f"2025-{m:02d}-{d:02d}" for m in range(1, 6) for d in range(1, 29)]
    book = ledger(spark, [entry(n, posted=x, source="GL" if n % 2 else "AP") for n, x in enumerate(days * 2, 1)])
    rule = drift.ProfileDrift(drift.DriftParams(min_period_entries=1, min_baseline_entries=1, min_category_baseline=1))
    assert rule.applicable(book)[0] and "BroadcastHashJoin [period" in plan(rule.flags(book))


def test_aging_counts_on_demand(spark):
    book = ledger(spark, [entry(1)])
    flags = spark.createDataFrame([("R-001", "E-1")], "rule_id string, entry_id string").select("rule_id", F.when(F.col("rule_id") == "R-001", F.raise_error(F.lit("read"))).otherwise(F.col("entry_id")).alias("entry_id"))
    assert aging.age_exceptions(flags, book, "2025-12").as_of == "2025-12"


def test_composition_looks_at_entries_once_for_all_dimensions(spark):
    book = ledger(spark, [entry(n) for n in range(1, 4)])
    assert plan(profile.composition(book.entries, dimensions=["by_weekday", "by_source"])).count("Generate explode") == 1
