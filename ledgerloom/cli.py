"""Command line: generate, test, report, grade, watch and size."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators import aging, benford, drift, periods, sampling
from .operators.card import build_report_card
from .operators.registry import BATTERIES, continuous_rules, default_rules, evaluate_all, sort_flags
from .report import workpapers as wp
from .session import get_session
from .sources import files
from .sources import generate as gen


def _plan(text: str | None, default: dict[str, int]) -> dict[str, int] | None:
    """None: nothing is planted. JSON, or class=count pairs."""
    if text in (None, "default"):
        return default
    if text == "none":
        return None
    if text.lstrip().startswith("{"):
        return json.loads(text)
    return {k: int(v) for k, v in (p.split("=") for p in text.split(","))}


def _load(spark, path: str):
    if Path(path, "entries").exists():
        return files.read_parquet(spark, path)
    return files.read_json(spark, path)


def _write(ledger, out: str, manifest=None, plan=None) -> None:
    """Parquet, from which the JSON and CSV forms are then written; entries stream through."""
    spark = ledger.entries.sparkSession
    files.write_parquet(ledger, out)
    ledger = files.read_parquet(spark, out)
    files.write_ledger_json(ledger, f"{out}/ledger.json")
    files.write_csv(ledger, f"{out}/ledger.csv")
    if manifest is not None:
        planted = ledger.meta["config"].get("anomaly_seed")
        files.write_json(f"{out}/manifest.json", files.manifest_dict(manifest, plan, ledger.meta["seed"], ledger.meta["seed"] if planted is None else planted))


def _config(a) -> gen.GeneratorConfig:
    return gen.GeneratorConfig(seed=a.seed, n_entries=a.entries, start=a.start, end=a.end, anomaly_seed=a.anomaly_seed)


def cmd_generate(spark, a) -> int:
    """Without a plan of either kind the default anomalies are planted."""
    cfg, drift_plan = _config(a), _plan(a.drift_plan, gen.default_drift_plan()) if a.drift_plan else None
    if a.plan not in (None, "none") and drift_plan:
        print("choose --plan or --drift-plan", file=sys.stderr)
        return 2
    if drift_plan:
        ledger, manifest = gen.generate_with_drift(spark, cfg, drift_plan)
        _write(ledger, a.out, manifest, drift_plan)
        return 0
    plan = _plan(a.plan, gen.default_plan())
    ledger, manifest = gen.generate_with_anomalies(spark, cfg, plan) if plan else (gen.generate(spark, cfg), None)
    _write(ledger, a.out, manifest, plan)
    return 0


def _run(spark, a, ledger, rules):
    """Evaluate and store: flags are computed once, into a table by rule."""
    flags, status = evaluate_all(ledger, rules)
    files.write_flags(sort_flags(flags), status, a.out)
    return spark.read.parquet(f"{a.out}/flags").select("rule_id", "entry_id", "rationale", "details"), status


def cmd_test(spark, a) -> int:
    ledger = _load(spark, a.ledger)
    flags, status = _run(spark, a, ledger, BATTERIES[a.battery]())
    files.write_flags_json(ledger, flags, status, f"{a.out}/flags.json")
    return 0


def cmd_report(spark, a) -> int:
    ledger, rules = _load(spark, a.ledger), BATTERIES[a.battery]()
    flags, status = _run(spark, a, ledger, rules)
    files.write_flags_json(ledger, flags, status, f"{a.out}/flags.json")
    wp.write_pack(f"{a.out}/workpapers", wp.battery_pack(ledger, rules, flags, status, benford.benford_for_ledger(ledger)))
    return 0


def _card(spark, a, plant, rules, name: str) -> int:
    seeds = [int(s) for s in a.seeds.split(",")]
    card = build_report_card(spark, seeds, plant, rules)
    files.write_json(f"{a.out}/{name}.json", card.to_dict())
    wp.write_pack(a.out, {name: wp.card_paper(card)})
    return 0


def _needed(a, default):
    plan = _plan(a.plan, default)
    if not plan:
        raise SystemExit("a report card needs planted cases; the plan is empty")
    return plan


def cmd_reportcard(spark, a) -> int:
    plan = _needed(a, gen.default_plan(8))
    return _card(spark, a, lambda s: gen.generate_with_anomalies(spark, gen.GeneratorConfig(seed=s, n_entries=a.entries), plan), default_rules(), "report-card")


def cmd_continuous(spark, a) -> int:
    ledger = _load(spark, a.ledger)
    p = drift.DriftParams(baseline_periods=a.baseline_periods, min_shift=a.min_shift)
    batches = [r.asDict() for r in periods.monthly_batches(ledger).collect()]
    if not batches:
        print("an empty ledger has no periods", file=sys.stderr)
        return 2
    report = drift.analyze(ledger, p)
    flags, _ = evaluate_all(ledger, [*default_rules(), drift.ProfileDrift(p)])
    schedule = aging.age_exceptions(flags.cache(), ledger, a.as_of)
    files.write_json(f"{a.out}/batches.json", batches)
    files.write_json(f"{a.out}/drift.json", {"applicable": report.applicable, "reason": report.reason, "baseline": report.baseline, "untested": report.untested, "findings": [r.asDict() for r in report.findings.orderBy("period", "dimension", "category").collect()] if report.applicable else []})
    files.write_json(f"{a.out}/aging.json", {"as_of": schedule.as_of, "n_not_yet_posted": schedule.n_not_yet_posted, "by_rule": [r.asDict() for r in schedule.by_rule().orderBy("rule_id").collect()], "oldest": [r.asDict() for r in schedule.oldest().collect()]})
    wp.write_pack(f"{a.out}/workpapers", wp.continuous_pack(ledger, report, schedule, batches, p))
    flags.unpersist()
    return 0


def cmd_continuous_card(spark, a) -> int:
    plan = _needed(a, gen.default_drift_plan())
    return _card(spark, a, lambda s: gen.generate_with_drift(spark, gen.GeneratorConfig(seed=s, n_entries=a.entries), plan), continuous_rules(), "continuous-report-card")


def cmd_ap_generate(spark, a) -> int:
    cfg, plan = _config(a), _plan(a.plan, gen.default_ap_plan())
    ledger, manifest = gen.generate_ap_with_duplicates(spark, cfg, plan) if plan else (gen.generate_ap_subledger(spark, cfg), None)
    _write(ledger, a.out, manifest, plan)
    return 0


def cmd_ap_card(spark, a) -> int:
    plan = _needed(a, gen.default_ap_plan())
    return _card(spark, a, lambda s: gen.generate_ap_with_duplicates(spark, gen.GeneratorConfig(seed=s, n_entries=a.entries), plan), BATTERIES["ap"](), "ap-report-card")


def cmd_sample_size(spark, a) -> int:
    """Plan a sample, or with --n and --deviations evaluate a completed one."""
    if (a.n is None) != (a.deviations is None):
        print("--n and --deviations go together", file=sys.stderr)
        return 2
    if a.n is not None:
        e = sampling.evaluate_attribute_sample(a.n, a.deviations, a.tolerable, a.risk, a.population)
        print(f"{a.deviations}/{a.n} deviations, upper limit {e.upper_limit:.4f} at risk {a.risk:g}, tolerable {a.tolerable:g}: {e.outcome}")
        return 0
    s = sampling.attribute_sample_size(a.tolerable, a.risk, a.expected, a.population)
    print(f"n={s.n}, allowed {s.allowed}/{s.n}, achieved risk {s.achieved_risk:.4f}")
    return 0


STAGES = ("ledger", "pack", "card", "readme")


def cmd_example(spark, a) -> int:
    """A whole run in stages: plant a ledger, test and report it, grade the battery, and say
    what lies where. A later stage alone reads what the earlier ones wrote."""
    from datetime import datetime, timezone

    stages = STAGES if a.stage == "all" else (a.stage,)
    cfg, plan, rules = gen.GeneratorConfig(seed=a.seed, n_entries=a.entries), gen.default_plan(4), default_rules()
    if "ledger" in stages:
        ledger, manifest = gen.generate_with_anomalies(spark, cfg, plan)
        files.write_parquet(ledger, f"{a.out}/ledger")
        files.write_json(f"{a.out}/manifest.json", files.manifest_dict(manifest, plan, a.seed, a.seed))
        files.write_json(f"{a.out}/run-meta.json", {"seed": a.seed, "entries": a.entries, "plan": plan, "generator": gen.VERSION, "spark": spark.version, "written": datetime.now(timezone.utc).isoformat(timespec="seconds")})
    if "pack" in stages:
        ledger = files.read_parquet(spark, f"{a.out}/ledger")
        flags, status = evaluate_all(ledger, rules)
        files.write_flags(sort_flags(flags), status, f"{a.out}/run")
        flags = spark.read.parquet(f"{a.out}/run/flags").select("rule_id", "entry_id", "rationale", "details")
        size = sampling.attribute_sample_size(0.05, 0.05)
        papers = wp.battery_pack(ledger, rules, flags, status, benford.benford_for_ledger(ledger)) | {"wp-sampling": wp.sampling_paper(size)}
        names = wp.write_pack(f"{a.out}/workpapers", papers)
        files.write_json(f"{a.out}/pack-summary.json", {"n_flags": flags.count(), "n_distinct_entries": flags.select("entry_id").distinct().count(), "n_workpapers": len(names)})
    if "card" in stages:
        seeds = [int(x) for x in a.card_seeds.split(",")]
        card = build_report_card(spark, seeds, lambda s: gen.generate_with_anomalies(spark, gen.GeneratorConfig(seed=s, n_entries=a.card_entries), gen.default_plan(8)), rules)
        files.write_json(f"{a.out}/report-card.json", card.to_dict())
        wp.write_pack(a.out, {"report-card": wp.card_paper(card)})
    if "readme" in stages:
        here = Path(a.out)
        have = [f"- `{x.relative_to(here)}`" for x in sorted(here.iterdir()) if x.name != "README.md"]
        files.write_text(here / "README.md", "\n".join(["# Example run", "", f"Seed {a.seed}, {a.entries} entries, anomalies planted by `manifest.json`.", "", *have, ""]))
    return 0


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description="Full-population tests of accounting ledgers on Spark.")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, out=True, ledger=False, **defaults):
        s = sub.add_parser(name)
        s.set_defaults(func=f)
        if out:
            s.add_argument("--out", required=True)
        if ledger:
            s.add_argument("--ledger", required=True)
        for k, v in defaults.items():
            s.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return s

    def planted(s):
        s.add_argument("--start", default="2025-01-01")
        s.add_argument("--end", default="2025-12-31")
        s.add_argument("--anomaly-seed", type=int, default=None)

    planted(add("generate", cmd_generate, seed=2026, entries=5000, plan=None, drift_plan=None))
    add("test", cmd_test, ledger=True).add_argument("--battery", choices=sorted(BATTERIES), default="default")
    add("report", cmd_report, ledger=True).add_argument("--battery", choices=sorted(BATTERIES), default="default")
    add("reportcard", cmd_reportcard, entries=5000, seeds="101,102,103,104,105", plan=None)
    s = add("continuous", cmd_continuous, ledger=True, min_shift=0.15, as_of=None)
    s.add_argument("--baseline-periods", "--baseline", type=int, default=3)
    add("continuous-card", cmd_continuous_card, entries=2400, seeds="501,502,503", plan=None)
    planted(add("ap-generate", cmd_ap_generate, seed=601, entries=900, plan=None))
    add("ap-card", cmd_ap_card, entries=900, seeds=",".join(map(str, range(601, 621))), plan=None)
    s = add("sample-size", cmd_sample_size, out=False, tolerable=0.05, risk=0.05, expected=0.0)
    for name in ("--population", "--n", "--deviations"):
        s.add_argument(name, type=int, default=None)
    s = add("example", cmd_example, seed=20260401, entries=100_000, card_entries=20_000, card_seeds="101,102,103,104,105")
    s.add_argument("--stage", choices=("all", *STAGES), default="all")
    return p


def main(argv: list[str] | None = None) -> int:
    a = build_parser().parse_args(argv)
    spark = None if a.command == "sample-size" else get_session(a.master)
    return a.func(spark, a)


if __name__ == "__main__":
    sys.exit(main())
