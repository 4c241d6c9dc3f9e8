"""Composition drift: shares of each month against a fixed baseline of the first months."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import disjoint, wilson
from ..model import Ledger, enrich
from .periods import monthly_batches
from .profile import composition, entry_dimensions
from .rules import Rule

SUPPORTED = ("by_preparer", "by_source", "by_weekday")


@dataclass(frozen=True)
class DriftParams:
    baseline_periods: int = 3
    dimensions: tuple[str, ...] = ("by_preparer", "by_source")
    min_shift: float = 0.15
    min_period_entries: int = 30
    min_baseline_entries: int = 100
    min_category_baseline: int = 10
    confidence: float = 0.95

    def __post_init__(self):
        wrong = [d for d in self.dimensions if d not in SUPPORTED]
        if wrong:
            raise ValueError(f"{wrong}: an account counts lines and a month is the period itself; choose from {SUPPORTED}")
        if self.baseline_periods < 1 or not 0 < self.min_shift < 1:
            raise ValueError("at least one baseline period, and a shift between 0 and 1")


@dataclass(frozen=True)
class DriftReport:
    applicable: bool
    reason: str
    baseline: list[str]
    tested: list[str]
    untested: list[tuple[str, int, str]]
    cells: DataFrame | None = None

    @property
    def findings(self) -> DataFrame | None:
        return None if self.cells is None else self.cells.where("shifted and apart")

    def findings_for(self, period: str) -> DataFrame | None:
        return None if self.cells is None else self.findings.where(F.col("period") == period)

    def flagged_entry_ids(self, ledger: Ledger) -> DataFrame:
        return cell_entries(ledger, self).select("entry_id").distinct()


def drift_cells(ledger: Ledger, baseline: list[str], tested: list[str], p: DriftParams) -> DataFrame:
    """(period, dimension, category, base_k, base_n, k, n, base_share, share, shift, four
    bounds, shifted, apart) for every tested period and category of the baseline with at
    least min_category_baseline entries; a category absent in a month counts zero."""
    e = enrich(ledger.entries).where(F.col("posting_period").isin([*baseline, *tested]))
    e = e.withColumn("slot", F.when(F.col("posting_period").isin(baseline), F.lit("")).otherwise(F.col("posting_period")))
    cells = composition(e, ["slot"], list(p.dimensions))
    cells = cells.withColumn("n", F.sum("k").over(W.partitionBy("slot", "dimension")))
    base = cells.where("slot = ''").select("dimension", "category", F.col("k").alias("base_k"), F.col("n").alias("base_n")).where(F.col("base_k") >= p.min_category_baseline)
    months = cells.where("slot <> ''").select(F.col("slot").alias("period"), "dimension", "n").distinct()
    grid = months.join(base, "dimension")
    seen = cells.where("slot <> ''").select(F.col("slot").alias("period"), "dimension", "category", "k")
    t = grid.join(seen, ["period", "dimension", "category"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    t = t.withColumns({"base_share": F.col("base_k") / F.col("base_n"), "share": F.col("k") / F.col("n")}).withColumn("shift", F.col("share") - F.col("base_share"))
    bl, bh = wilson(F.col("base_k"), F.col("base_n"), p.confidence)
    lo, hi = wilson(F.col("k"), F.col("n"), p.confidence)
    t = t.withColumns({"base_low": bl, "base_high": bh, "low": lo, "high": hi})
    return t.withColumns({"shifted": F.abs("shift") >= p.min_shift, "apart": disjoint(F.col("base_low"), F.col("base_high"), F.col("low"), F.col("high"))})


def analyze(ledger: Ledger, p: DriftParams = DriftParams()) -> DriftReport:
    """Refuses with a reason where there is nothing to compare; months with few entries are
    reported as untested."""
    batches = [(r["period"], r["n_entries"]) for r in monthly_batches(ledger).collect()]
    base, rest = batches[: p.baseline_periods], batches[p.baseline_periods :]
    if not rest:
        return DriftReport(False, f"{len(batches)} period(s) leave none to test after {p.baseline_periods}", [b for b, _ in base], [], [])
    n = sum(k for _, k in base)
    if n < p.min_baseline_entries:
        return DriftReport(False, f"the baseline has {n} entries, fewer than {p.min_baseline_entries}", [b for b, _ in base], [], [])
    few = [(b, k, f"n={k} is under {p.min_period_entries}") for b, k in rest if k < p.min_period_entries]
    tested = [b for b, k in rest if k >= p.min_period_entries]
    baseline = [b for b, _ in base]
    return DriftReport(True, "", baseline, tested, few, drift_cells(ledger, baseline, tested, p))


def statement(period, dimension, category, base_k, base_n, k, n, base_low, base_high, low, high):
    """One sentence of a finding, for a collected row."""
    way = "rose" if k / n > base_k / base_n else "fell"
    return f"{period}: {dimension} {category} {way} from {base_k}/{base_n} ({base_low:.4f}-{base_high:.4f}) to {k}/{n} ({low:.4f}-{high:.4f}), shift {k / n - base_k / base_n:+.4f}"


def cell_entries(ledger: Ledger, report: DriftReport) -> DataFrame:
    """(entry_id and the finding's columns) of entries in cells that grew; shrunken cells
    have no entries to show."""
    grew = report.findings.where("shift > 0")
    e = enrich(ledger.entries)
    kinds = entry_dimensions()
    names = [d for d in SUPPORTED if d in kinds]
    cells = e.select("entry_id", F.col("posting_period").alias("period"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), kinds[d].alias("category")) for d in names])).alias("c")).select("entry_id", "period", "c.*")
    # shares of a period add up to 1 and each grew by min_shift, so 1 / min_shift categories
    # of a dimension and period are here at most
    return cells.join(F.broadcast(grew), ["period", "dimension", "category"])


class ProfileDrift(Rule):
    rule_id, title, targets = "R-012", "Drift of the monthly composition", ("preparer_concentration_drift", "manual_source_surge")
    population_description = "entries of tested periods"
    criterion = "the entry is in a category whose share grew past the floor, intervals apart"
    limitations = "one flag a finding: an entry in two grown cells is flagged twice"

    def __init__(self, params: DriftParams = DriftParams()):
        self._params = params
        self._report: tuple[Ledger, DriftReport] | None = None

    def params(self):
        return {k: list(v) if isinstance(v, tuple) else v for k, v in vars(self._params).items()}

    def report(self, ledger: Ledger) -> DriftReport:
        if self._report is None or self._report[0] is not ledger:
            self._report = (ledger, analyze(ledger, self._params))
        return self._report[1]

    def applicable(self, ledger):
        r = self.report(ledger)
        return r.applicable, r.reason

    def population(self, ledger):
        return enrich(ledger.entries).where(F.col("posting_period").isin(self.report(ledger).tested or [""]))

    def flags(self, ledger):
        c = cell_entries(ledger, self.report(ledger))
        share = lambda k, n: F.concat(F.col(k).cast("string"), F.lit("/"), F.col(n).cast("string"))
        bounds = lambda a, b: F.concat(F.lit(" ("), F.round(a, 4).cast("string"), F.lit("-"), F.round(b, 4).cast("string"), F.lit(")"))
        text = F.concat(F.col("period"), F.lit(": "), F.col("dimension"), F.lit(" "), F.col("category"), F.lit(" rose from "), share("base_k", "base_n"), bounds("base_low", "base_high"), F.lit(" to "), share("k", "n"), bounds("low", "high"))
        return c.select("entry_id", text.alias("rationale"), "period", "dimension", "category", F.lit("increase").alias("direction"), "shift")
