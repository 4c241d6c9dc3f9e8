"""Workpapers from aggregates and at most 25 exceptions a rule."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import EXCEPTION, INCONCLUSIVE, PASS, Decision
from ..model import Ledger
from ..operators import profile
from ..operators.benford import Benford
from ..operators.card import ReportCard
from ..operators.drift import DriftParams
from ..operators.rules import REFERENCES, Rule
from ..operators.sampling import BRIDGE_NOTE, Evaluation, SampleSize
from ..sources.files import write_text
from .document import Document, Heading, KeyValues, ListBlock, Paragraph, Table, to_html, to_markdown

SHOWN = 25
_SAYS = {
    PASS: "No exception in the population. The test speaks for what it tests, no further.",
    EXCEPTION: "Exceptions were found. Each is a lead to be followed up, not a conclusion.",
    INCONCLUSIVE: "The test supports no conclusion here.",
}


def outcome_of(applicable: bool, population: int, flags: int) -> str:
    return INCONCLUSIVE if not applicable or not population else EXCEPTION if flags else PASS


def conclusion(outcome: str) -> str:
    return _SAYS[outcome]


def engagement(ledger: Ledger) -> KeyValues:
    m = ledger.meta
    t = m.get("approval_threshold_cents")
    return KeyValues((("Fiscal year", f"{m.get('fiscal_year_start', 'not declared')} to {m.get('fiscal_year_end', 'not declared')}"), ("Approval threshold", f"{t // 100}.{t % 100:02d}" if t is not None else "not declared"), ("Seed", str(m.get("seed", "none")))))


def first_exceptions(flags: DataFrame) -> dict[str, list]:
    """The first SHOWN flags of each rule; one job for all rules."""
    n = F.row_number().over(W.partitionBy("rule_id").orderBy("entry_id", "details"))
    out: dict[str, list] = {}
    for r in flags.withColumn("n", n).where(F.col("n") <= SHOWN).orderBy("rule_id", "n").collect():
        out.setdefault(r["rule_id"], []).append(r)
    return out


def rule_paper(rule: Rule, ledger: Ledger, status: dict, n_flags: int, shown: list) -> Document:
    outcome = outcome_of(status["applicable"], status["population_size"], n_flags)
    blocks = [
        engagement(ledger),
        Heading("Test"),
        KeyValues((("Rule", rule.rule_id), ("Population", f"{rule.population_description}, n={status['population_size']}"), ("Criterion", rule.criterion), ("Parameters", ", ".join(f"{k}={v}" for k, v in rule.params().items()) or "none"))),
        ListBlock(tuple(f"{r}: {REFERENCES[r]}" for r in rule.references)),
        Heading("Outcome"),
        KeyValues((("Outcome", outcome), ("Exceptions", f"{n_flags}/{status['population_size']}"))),
        Paragraph(conclusion(outcome) if status["applicable"] else f"Not applicable: {status['reason']}."),
    ]
    if shown:
        blocks += [Heading("Exceptions"), Table(("Entry", "Why"), tuple((r["entry_id"], r["rationale"]) for r in shown))]
        if n_flags > len(shown):
            blocks.append(Paragraph(f"The first {len(shown)} of {n_flags}; all are in the flags table."))
    if rule.limitations:
        blocks += [Heading("Limitations"), Paragraph(rule.limitations)]
    return Document(f"{rule.rule_id} {rule.title}", tuple(blocks))


def benford_paper(tests: tuple[Benford, ...]) -> Document:
    blocks: list = []
    for t in tests:
        blocks.append(Heading({1: "First digit", 2: "Second digit"}[t.place]))
        if not t.applicable:
            blocks.append(Paragraph(f"Refused (n={t.n}): {t.reason}."))
            continue
        blocks.append(KeyValues((("n", str(t.n)), ("Mean absolute deviation", f"{t.mad:.4f} ({t.band})"), ("Chi-square", f"{t.chi_square:.2f}, p={t.p_value:.4f}"), ("Outcome", t.outcome))))
        blocks.append(Table(("Digit", "Observed", "Expected share", "Interval"), tuple((str(d["digit"]), f"{d['observed']}/{d['n']}", f"{d['expected_share']:.4f}", f"{d['low']:.4f}-{d['high']:.4f}") for d in t.digits)))
    return Document("Digit tests", tuple(blocks))


def population_blocks(ledger: Ledger) -> list:
    """What the tests looked at: counts, dates, sources and the largest amounts."""
    row = profile.scalars(ledger).first()
    tally = profile.with_totals(profile.composition(ledger.entries, dimensions=["by_source"])).orderBy("category").collect()
    largest = profile.top_amounts(ledger).collect()
    money = lambda c: f"{c // 100}.{c % 100:02d}"
    said = lambda x: "no threshold declared" if x is None else str(x)
    return [
        Heading("Population"),
        KeyValues((
            ("Entries and lines", f"{row['n_entries']} and {row['n_lines']}"), ("Posted", f"{row['first_posting']} to {row['last_posting']}"), ("Total amount", money(row["total_amount_cents"])),
            ("By source", ", ".join(f"{r['category']} {r['k']}/{r['n']}" for r in tally) or "none"),
            ("Requiring approval", said(row["requiring_approval"])), ("Approval missing", said(row["missing_approval"])),
        )),
        Table(("Largest entries", "Amount"), tuple((r["entry_id"], money(r["amount_cents"])) for r in largest)),
    ]


def lead_sheet(ledger: Ledger, rules: list[Rule], status: dict[str, dict], counts: dict[str, int], n_entries: int, n_distinct: int, tests: tuple[Benford, ...] = ()) -> Document:
    rows = tuple((r.rule_id, r.title, str(status[r.rule_id]["population_size"]), str(counts.get(r.rule_id, 0)), outcome_of(status[r.rule_id]["applicable"], status[r.rule_id]["population_size"], counts.get(r.rule_id, 0))) for r in rules)
    share = f"{n_distinct}/{n_entries}" if n_entries else "no entries"
    blocks = [engagement(ledger), *population_blocks(ledger), Heading("Rules"), Table(("Rule", "Title", "Population", "Flags", "Outcome"), rows), Paragraph(f"Distinct flagged entries: {share}.")]
    refused = [f"{r.rule_id}: {status[r.rule_id]['reason']}" for r in rules if not status[r.rule_id]["applicable"]]
    if refused:
        blocks += [Heading("Rules that refused"), ListBlock(refused)]
    if tests:
        blocks += [Heading("Digit tests"), Table(("Test", "n", "Mean absolute deviation", "Outcome"), tuple((f"digit {t.place}", str(t.n), f"{t.mad:.4f} ({t.band})" if t.applicable else t.reason, t.outcome) for t in tests))]
    return Document("Lead sheet", tuple(blocks))


def _decision_row(name: str, d: Decision) -> tuple[str, ...]:
    m = d.measurement
    return (name, f"{m.numerator}/{m.n}" if m.n else "not tested", f"{m.value:.4f} ({m.low:.4f}-{m.high:.4f})", f"{d.threshold:g}", d.outcome)


def card_paper(card: ReportCard, title: str = "Report card") -> Document:
    head = ("Measure", "k/n", "Value and interval", "Target", "Outcome")
    classes = {c["anomaly_class"]: c for c in card.classes}
    return Document(title, (
        KeyValues((("Seeds", ", ".join(map(str, card.seeds))),)),
        Heading("Recall"), Table(head, tuple(_decision_row(k, d) for k, d in card.recall.items())),
        Table(("Class", "By design", "Designed rules", "Single seeds"), tuple((k, f"{c['by_design']}/{c['planted']}", ", ".join(c["designed_rules"]), f"{c['lowest']:.4f} to {c['highest']:.4f}") for k, c in classes.items())),
        Heading("Precision and false positives"), Table(head, (_decision_row("precision", card.precision), _decision_row("false positives among clean entries", card.fp_rate))),
        Heading("Rules"), Table(("Rule", "Planted of flagged"), tuple((r["rule_id"], f"{r['planted']}/{r['flagged']}" if r["flagged"] else "no flags") for r in card.rules)),
        Heading("Definitions"),
        ListBlock(("Recall: planted instances any rule flagged, of those planted.", "Precision: flagged entries that were planted, of those flagged.", "False positives: clean entries flagged, of clean entries.", "Pooled over seeds by summing counts; intervals are Wilson's.")),
    ))


#: Findings that the drift paper prints; it says how many there are.
PRINTED = 200


def drift_paper(report, params: DriftParams = DriftParams()) -> Document:
    """What was compared with what, by which criterion, what moved, and what that cannot say."""
    criterion = [
        Heading("Criterion"),
        Paragraph(f"A cell is reported if its share moved by {params.min_shift:g} or more and the {params.confidence:g} intervals of the two shares do not meet. Dimensions: {', '.join(params.dimensions)}."),
        Paragraph(f"Months with fewer than {params.min_period_entries} entries and categories with fewer than {params.min_category_baseline} in the baseline are not tested; the baseline has {params.min_baseline_entries} entries at least."),
    ]
    limits = [
        Heading("Limitations"),
        ListBlock(("A shift may have an ordinary reason: a new colleague, a new system, a season.", "The baseline is taken as it is; what was unusual in it is not seen.", "Many cells are compared, so some may move by chance; the floor on the shift keeps these few.")),
    ]
    if not report.applicable:
        return Document("Composition drift", (*criterion, Heading("Outcome"), KeyValues((("Outcome", INCONCLUSIVE),)), Paragraph(f"Not applicable: {report.reason}."), *limits))
    n = report.findings.count()
    rows = report.findings.orderBy("period", "dimension", "category").limit(PRINTED).collect()
    outcome = outcome_of(True, len(report.tested), n)
    blocks = [
        KeyValues((("Baseline", ", ".join(report.baseline)), ("Tested periods", str(len(report.tested))), ("Untested", "; ".join(f"{p} ({w})" for p, _, w in report.untested) or "none"))),
        *criterion,
        Heading("Outcome"),
        KeyValues((("Outcome", outcome), ("Findings", str(n)))),
        Paragraph(conclusion(outcome)),
    ]
    blocks.append(Table(("Period", "Dimension", "Category", "Baseline", "Period k/n", "Shift"), tuple((r["period"], r["dimension"], r["category"], f"{r['base_k']}/{r['base_n']}", f"{r['k']}/{r['n']}", f"{r['shift']:+.4f}") for r in rows)) if rows else Paragraph("No cell moved past the floor with its intervals apart."))
    if n > len(rows):
        blocks.append(Paragraph(f"The first {len(rows)} of {n}; all are in drift.json."))
    return Document("Composition drift", (*blocks, *limits))


def batches_paper(batches: list[dict]) -> Document:
    """The months of a continuous run, in order."""
    names = tuple(batches[0]) if batches else ("period",)
    return Document("Monthly batches", (Table(names, tuple(tuple(str(b[k]) for k in names) for b in batches)),))


def continuous_pack(ledger: Ledger, report, schedule, batches: list[dict], params: DriftParams = DriftParams()) -> dict[str, Document]:
    """The papers of a continuous run and a sheet over them."""
    n = report.findings.count() if report.applicable else 0
    aged = schedule.by_bucket().orderBy("bucket").collect()
    cover = Document("Continuous monitoring", (
        engagement(ledger),
        KeyValues((("Months", f"{batches[0]['period']} to {batches[-1]['period']}, n={len(batches)}" if batches else "none"), ("Drift", f"{n} findings" if report.applicable else f"not applicable: {report.reason}"), ("Aged to", schedule.as_of))),
        Table(("Months old", "Flags", "Entries"), tuple((r["bucket"], str(r["flags"]), str(r["entries"])) for r in aged)),
    ))
    return {"continuous-sheet": cover, "wp-batches": batches_paper(batches), "wp-drift": drift_paper(report, params), "wp-aging": aging_paper(schedule)}


def aging_paper(schedule) -> Document:
    by = schedule.by_rule().orderBy("rule_id").collect()
    labels = [c for c in (by[0].asDict() if by else {}) if c != "rule_id"]
    old = schedule.oldest(SHOWN).collect()
    return Document("Aging of exceptions", (
        KeyValues((("As of", schedule.as_of), ("Not yet posted", str(schedule.n_not_yet_posted)))),
        Table(("Rule", *labels), tuple((r["rule_id"], *(str(r[c]) for c in labels)) for r in by)),
        Heading("Oldest"), Table(("Rule", "Entry", "First seen", "Months"), tuple((r["rule_id"], r["entry_id"], r["first_seen"], str(r["age_months"])) for r in old)),
    ))


def sampling_paper(size: SampleSize, evaluation: Evaluation | None = None) -> Document:
    blocks = [KeyValues((("Sample size", str(size.n)), ("Deviations allowed", f"{size.allowed}/{size.n}"))), Paragraph(BRIDGE_NOTE)]
    if evaluation:
        blocks.append(KeyValues((("Outcome", evaluation.outcome), ("Upper limit", f"{evaluation.upper_limit:.4f}"))))
    return Document("Attribute sampling", tuple(blocks))


def write_pack(folder: str | Path, papers: dict[str, Document]) -> list[str]:
    for name, doc in papers.items():
        write_text(Path(folder) / f"{name}.md", to_markdown(doc))
        write_text(Path(folder) / f"{name}.html", to_html(doc))
    return sorted(papers)


def battery_pack(ledger: Ledger, rules: list[Rule], flags: DataFrame, status: DataFrame, tests: tuple[Benford, ...] = ()) -> dict[str, Document]:
    """A paper for each rule, the digit tests, and the lead sheet."""
    st = {r["rule_id"]: r.asDict() for r in status.collect()}
    counts = {r["rule_id"]: r["n"] for r in flags.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    shown = first_exceptions(flags)
    papers = {f"wp-{r.rule_id.lower()}": rule_paper(r, ledger, st[r.rule_id], counts.get(r.rule_id, 0), shown.get(r.rule_id, [])) for r in rules}
    if tests:
        papers["wp-benford"] = benford_paper(tests)
    papers["lead-sheet"] = lead_sheet(ledger, rules, st, counts, ledger.entries.count(), flags.select("entry_id").distinct().count(), tests)
    return papers
