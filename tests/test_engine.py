import os

import duckdb
import pytest
from helpers import entry, invoice, ledger
from pyspark.sql import functions as F

from ledgerloom.operators import card, drift, registry
from ledgerloom.plans import registry as plans
from ledgerloom.report import document as doc
from ledgerloom.report import workpapers as wp
from ledgerloom.sources import files
from ledgerloom.sources import generate as gen
from ledgerloom.streaming import continuous

SF = "/root/testdata/sf0.001"


def test_json_round_trip(spark, tmp_path):
    book = ledger(spark, [entry(1), invoice(2), entry(3, approver=None)])
    files.write_json_compact(tmp_path / "ledger.json", files.ledger_dict(book))
    again = files.read_json(spark, str(tmp_path))
    assert files.ledger_dict(again)["entries"] == files.ledger_dict(book)["entries"]
    assert again.entries.orderBy("entry_seq").first()["lines"][0]["line_no"] == 1
    files.write_parquet(book, str(tmp_path / "p"), by_period=True)
    assert files.read_parquet(spark, str(tmp_path / "p")).meta == book.meta
    rows = {(r["entry_id"], r["line_no"]): r for r in files.csv_rows(book).collect()}
    assert rows["E-1", "1"]["debit"] == "4312.70" and rows["E-1", "1"]["credit"] == "" and rows["E-3", "1"]["approver_id"] == ""
    assert files.canonical_json({"b": 1, "a": [1.5, "é", None, True]}) == '{"a":[1.5,"\\u00e9",null,true],"b":1}'
    with pytest.raises(ValueError):
        files.canonical_json(float("nan"))


def test_generator(spark):
    cfg = gen.GeneratorConfig(seed=42, n_entries=900)
    a, b = gen.generate(spark, cfg), gen.generate(spark, cfg)
    key = lambda x: x.entries.repartition(3).agg(F.sum(F.xxhash64("entry_id", "description", F.to_json("lines")).cast("decimal(38,0)"))).first()[0]
    assert key(a) == key(b) and a.entries.count() == 900
    a.validate()
    assert a.entries.where("source = 'PAY'").count() == 26
    whole = a.enriched().where("amount_cents % 100 = 0").groupBy("amount_cents").count().collect()
    assert {(r["amount_cents"], r["count"]) for r in whole} == {(900_000, 12), (240_000, 12)}


def test_planted_cases_are_found(spark):
    book, manifest = gen.generate_with_anomalies(spark, gen.GeneratorConfig(seed=7, n_entries=1200))
    flags, _ = registry.evaluate_all(book)
    found = card.instances(manifest, flags.withColumn("seed", F.lit(7)), card.designed(spark, registry.default_rules())).cache()
    assert found.count() == 23 and found.where("not by_design").count() == 0
    fewer = flags.where("rule_id <> 'R-009'").withColumn("seed", F.lit(7))
    lost = card.recall_by_class(card.instances(manifest, fewer, card.designed(spark, registry.default_rules()))).where("anomaly_class = 'self_approval'").first()
    assert lost["by_design"] == 0
    with pytest.raises(ValueError):
        gen.generate_with_anomalies(spark, gen.GeneratorConfig(), {"nonsense": 1})


def test_drift_plants_and_payables(spark):
    book, manifest = gen.generate_with_drift(spark, gen.GeneratorConfig(seed=501, n_entries=2400))
    ids = {x for r in manifest.collect() for x in r["entry_ids"]}
    flagged = {r["entry_id"] for r in drift.ProfileDrift().flags(book).collect()}
    assert ids & flagged and len(ids - flagged) < len(ids)
    assert drift.analyze(gen.generate(spark, gen.GeneratorConfig(seed=501, n_entries=2400))).findings.count() == 0
    ap, planted = gen.generate_ap_with_duplicates(spark)
    f, _ = registry.evaluate_all(ap, registry.ap_rules())
    got = card.instances(planted, f.withColumn("seed", F.lit(601)), card.designed(spark, registry.ap_rules()))
    assert got.where("by_design").count() == 8


def test_planted_references_are_not_issued_on_a_large_ledger(spark):
    ap, _ = gen.generate_ap_with_duplicates(spark, gen.GeneratorConfig(seed=601, n_entries=200_100), {"ap_transposed_reference": 20})
    twice = ap.entries.groupBy("document.party_id", "document.reference").count().where("count > 1")
    assert twice.count() == 0


def test_drift_paper_counts_what_it_leaves_out(spark):
    from types import SimpleNamespace

    findings = spark.range(230).selectExpr("'2025-07' as period", "'preparer' as dimension", "concat('P-', id) as category", "1L as base_k", "9L as base_n", "5L as k", "9L as n", "0.4d as shift")
    report = lambda f: SimpleNamespace(applicable=True, findings=f, baseline=["2025-01"], tested=["2025-07"], untested=[])
    assert "The first 200 of 230; all are in drift.json." in doc.to_markdown(wp.drift_paper(report(findings)))
    assert "The first" not in doc.to_markdown(wp.drift_paper(report(findings.limit(200))))


def test_workpapers(spark):
    book = ledger(spark, [entry(1, approver="P-01"), entry(2, 1_500_000)])
    rules = registry.default_rules()
    flags, status = registry.evaluate_all(book, rules)
    papers = wp.battery_pack(book, rules, flags.cache(), status)
    for p in papers.values():
        text = doc.to_markdown(p)
        assert not doc.bare_rates_in(text) and not doc.prohibited_in(text)
        assert "http" not in doc.to_html(p) and "<script" not in doc.to_html(p)
    assert "inconclusive" in doc.to_markdown(papers["wp-r-008"])
    with pytest.raises(doc.LanguageError):
        doc.to_markdown(doc.Document("x", (doc.Paragraph("this proves fraud"),)))
    with pytest.raises(ValueError):
        doc.Table(("a", "b"), (("1",),))


def test_streaming_equals_batch(spark, tmp_path):
    book = ledger(spark, [entry(1, approver="P-01"), entry(2, 1_500_000), entry(3, text=""), entry(4, 10_000, credit=9_000)])
    src = str(tmp_path / "in")
    book.entries.coalesce(1).write.parquet(src)
    flags = continuous.record_flags(continuous.read_entries(spark, src), book)
    continuous.run_available(flags, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    key = lambda df: {(r["rule_id"], r["entry_id"]) for r in df.collect()}
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(continuous.record_flags(book.entries, book))


def test_stream_of_months_and_duplicates(spark, tmp_path):
    """A row a month and source, joined with a baseline; duplicate pairs as in the batch."""
    book = ledger(spark, [entry(1, posted="2025-01-05"), entry(2, posted="2025-01-20"), entry(3, 777_700, posted="2025-02-03", source="AP"), entry(4, 777_700, posted="2025-02-05", source="AP"), entry(5, 888_800, posted="2025-06-30")])
    src = str(tmp_path / "in")
    book.entries.coalesce(1).write.parquet(src)
    stream = continuous.read_entries(spark, src)
    base = spark.createDataFrame([("GL", 10, 40)], "source string, base_k long, base_n long")
    got = {}
    for name, df in (("m", continuous.against_baseline(continuous.month_counts(stream), base)), ("d", continuous.duplicate_pairs(stream, 7))):
        continuous.run_available(df, str(tmp_path / name), str(tmp_path / f"cp-{name}")).awaitTermination()
        got[name] = spark.read.parquet(str(tmp_path / name)).collect()
    # June is still open: its watermark has not passed
    assert {(r["month"], r["source"], r["k"], r["base_k"]) for r in got["m"]} == {("2025-01", "GL", 2, 10), ("2025-02", "AP", 2, None)}
    assert {(r["first_id"], r["second_id"]) for r in got["d"]} == {("E-3", "E-4")}


def test_aging_keeps_its_buckets(spark):
    from ledgerloom.operators import aging

    book = ledger(spark, [entry(n, posted=f"2025-{n:02d}-10") for n in (1, 6, 12)])
    flags = spark.createDataFrame([("R-001", f"E-{n}", "", "{}") for n in (1, 6, 12)], "rule_id string, entry_id string, rationale string, details string")
    s = aging.age_exceptions(flags, book, "2025-12", (0, 6, 11))
    row = s.by_rule().first()
    assert (row["0"], row["6"], row["11+"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        aging.age_exceptions(flags, book, "2025-12", (3, 1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(plans.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    got = plans.QUERIES[name](spark, SF).select(*[f"`{c}`" for c in names]).collect()
    norm = lambda rows: sorted([tuple(round(x, 9) if isinstance(x, float) else str(x) if x is not None and not isinstance(x, (int, bool)) else x for x in r) for r in rows], key=str)
    assert norm(got) == norm(want)
