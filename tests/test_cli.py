import json

import pytest

from ledgerloom import cli


def test_sample_size(capsys):
    assert cli.main(["sample-size", "--tolerable", "0.05", "--risk", "0.05"]) == 0
    assert "n=59" in capsys.readouterr().out


def test_generate_test_continuous(spark, tmp_path):
    book = str(tmp_path / "book")
    assert cli.main(["generate", "--out", book, "--entries", "400", "--plan", "self_approval=2,unbalanced_entry=1"]) == 0
    manifest = json.loads((tmp_path / "book" / "manifest.json").read_text())
    assert manifest["n_anomalies"] == 3
    assert cli.main(["test", "--ledger", book, "--out", str(tmp_path / "t")]) == 0
    results = json.loads((tmp_path / "t" / "flags.json").read_text())["results"]
    planted = {x for a in manifest["anomalies"] for x in a["entry_ids"]}
    assert planted <= {f["entry_id"] for r in results.values() for f in r["flags"]}
    assert results["R-008"]["applicable"] is False
    assert cli.main(["continuous", "--ledger", f"{book}/ledger.json", "--out", str(tmp_path / "c")]) == 0
    assert json.loads((tmp_path / "c" / "aging.json").read_text())["as_of"]


def test_refusals(spark, tmp_path):
    assert cli.main(["generate", "--out", str(tmp_path), "--plan", "default", "--drift-plan", "default"]) == 2
    with pytest.raises(SystemExit):
        cli.main(["reportcard", "--out", str(tmp_path), "--plan", "none"])


def test_sample_evaluation(capsys):
    assert cli.main(["sample-size", "--tolerable", "0.05", "--risk", "0.05", "--n", "59", "--deviations", "0"]) == 0
    assert "0/59" in capsys.readouterr().out
    assert cli.main(["sample-size", "--tolerable", "0.05", "--risk", "0.05", "--n", "59"]) == 2


def test_another_year_and_seed_of_plants(spark, tmp_path):
    book = lambda name, seed: [str(tmp_path / name), "--entries", "300", "--start", "2023-07-01", "--end", "2024-06-30", "--anomaly-seed", str(seed), "--plan", '{"self_approval": 2, "weekend_manual": 1}']
    for name, seed in (("a", 1), ("b", 1), ("c", 2)):
        assert cli.main(["generate", "--out", *book(name, seed)]) == 0
    a, b, c = (json.loads((tmp_path / x / "ledger.json").read_text()) for x in "abc")
    assert a == b and a["entries"] != c["entries"] and a["meta"]["fiscal_year_end"] == "2024-06-30"
    assert all("2023-07-01" <= e["posting_date"] <= "2024-06-30" for e in a["entries"])
    contra = next(x for x in a["coa"] if x["account_id"] == "1510")
    assert contra["normal_side"] == "credit"
    m = json.loads((tmp_path / "c" / "manifest.json").read_text())
    assert (m["generator_seed"], m["anomaly_seed"], m["n_anomalies"]) == (2026, 2, 3)


def test_payables_report_and_aging_date(spark, tmp_path):
    out = str(tmp_path / "ap")
    assert cli.main(["ap-generate", "--out", out, "--entries", "300"]) == 0
    assert cli.main(["report", "--ledger", out, "--battery", "ap", "--out", str(tmp_path / "r")]) == 0
    assert {p.name for p in (tmp_path / "r" / "workpapers").glob("wp-ap*.md")} == {"wp-ap-001.md", "wp-ap-002.md"}
    sheet = (tmp_path / "r" / "workpapers" / "lead-sheet.md").read_text()
    assert "Entries and lines" in sheet and "AP 300/" not in sheet.split("By source")[0]
    results = json.loads((tmp_path / "r" / "flags.json").read_text())["results"]
    assert all(len(x["flags"]) == x["n_flags"] for x in results.values()) and results["AP-001"]["n_flags"] > 0
    assert cli.main(["continuous", "--ledger", out, "--out", str(tmp_path / "c"), "--as-of", "2026-03", "--baseline-periods", "4"]) == 0
    assert json.loads((tmp_path / "c" / "aging.json").read_text())["as_of"] == "2026-03"
    text = (tmp_path / "c" / "workpapers" / "wp-drift.md").read_text()
    assert "Criterion" in text and "Limitations" in text and (tmp_path / "c" / "workpapers" / "continuous-sheet.md").exists()


def test_example_in_stages(spark, tmp_path):
    out = str(tmp_path / "e")
    base = ["example", "--out", out, "--entries", "600", "--card-entries", "600", "--card-seeds", "7"]
    assert cli.main([*base, "--stage", "ledger"]) == 0
    assert (tmp_path / "e" / "run-meta.json").exists() and not (tmp_path / "e" / "workpapers").exists()
    assert cli.main([*base, "--stage", "pack"]) == 0
    summary = json.loads((tmp_path / "e" / "pack-summary.json").read_text())
    assert summary["n_workpapers"] == len(list((tmp_path / "e" / "workpapers").glob("*.md"))) and (tmp_path / "e" / "workpapers" / "wp-sampling.md").exists()
    assert cli.main([*base, "--stage", "readme"]) == 0
    assert "pack-summary.json" in (tmp_path / "e" / "README.md").read_text()
