"""Monthly batches by posting date: a partition column, never separate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ledger, enrich


def monthly_batches(ledger: Ledger) -> DataFrame:
    """(period, n_entries), ascending; months without entries have no batch."""
    return enrich(ledger.entries).groupBy(F.col("posting_period").alias("period")).agg(F.count("*").alias("n_entries")).orderBy("period")


def sub_ledger(ledger: Ledger, period: str) -> Ledger:
    return ledger.where(F.date_format("posting_date", "yyyy-MM") == period, batch=period)


def combine_batches(ledger: Ledger, periods: list[str]) -> Ledger:
    return ledger.where(F.date_format("posting_date", "yyyy-MM").isin(periods), batch="+".join(periods))


def split_baseline(ledger: Ledger, n: int = 3) -> tuple[list[str], list[str]]:
    """The first n months that have entries, and the others."""
    if n < 1:
        raise ValueError("a baseline has at least one period")
    periods = [r["period"] for r in monthly_batches(ledger).collect()]
    return periods[:n], periods[n:]
