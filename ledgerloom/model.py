"""The ledger: three DataFrames and small driver-side metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import domain_faults, duplicate_keys, line_faults

#: Enriched columns that rules read; see enrich().
DERIVED = ("total_debits_cents", "total_credits_cents", "amount_cents", "fiscal_period", "posting_period", "account_ids", "debit_account_ids", "credit_account_ids")


@dataclass(frozen=True)
class Ledger:
    """entries (one row an entry, nested lines), accounts, users, meta.

    meta keys may be missing (fiscal_year_start, fiscal_year_end, approval_threshold_cents,
    seed, ...); rules that need one refuse without it."""

    entries: DataFrame
    accounts: DataFrame
    users: DataFrame | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def enriched(self) -> DataFrame:
        return enrich(self.entries)

    def where(self, condition, **meta: Any) -> "Ledger":
        """A sub-ledger: filtered entries, a copy of meta with additions."""
        return replace(self, entries=self.entries.where(condition), meta={**self.meta, **meta})

    def validate(self) -> None:
        """Raise on structural faults; looks at a few examples of each kind."""
        for what, df in (
            ("duplicate entry_id", duplicate_keys(self.entries, "entry_id")),
            ("duplicate account_id", duplicate_keys(self.accounts, "account_id")),
            ("line", line_faults(self.entries)),
            ("domain", domain_faults(self.accounts, self.users)),
        ):
            bad = df.limit(5).collect()
            if bad:
                raise ValueError(f"{what}: {[r.asDict() for r in bad]}")


def enrich(entries: DataFrame) -> DataFrame:
    """Add the derived columns. An entry's amount is the larger of its two totals."""
    if set(DERIVED) <= set(entries.columns):
        return entries
    ids = "array_sort(array_distinct(transform({}, l -> l.account_id)))"
    e = entries.withColumns({
        "total_debits_cents": F.expr("aggregate(lines, 0L, (a, l) -> a + l.debit_cents)"),
        "total_credits_cents": F.expr("aggregate(lines, 0L, (a, l) -> a + l.credit_cents)"),
        "fiscal_period": F.date_format("effective_date", "yyyy-MM"),
        "posting_period": F.date_format("posting_date", "yyyy-MM"),
        "account_ids": F.expr(ids.format("lines")),
        "debit_account_ids": F.expr(ids.format("filter(lines, l -> l.debit_cents > 0)")),
        "credit_account_ids": F.expr(ids.format("filter(lines, l -> l.credit_cents > 0)")),
    })
    return e.withColumn("amount_cents", F.greatest("total_debits_cents", "total_credits_cents"))


def line_fact(entries: DataFrame) -> DataFrame:
    """One row a line: the entry's scalars and the line's columns."""
    return entries.select("entry_seq", "entry_id", "posting_date", "effective_date", "source", "preparer_id", F.explode("lines").alias("l")).select("*", "l.*").drop("l")
