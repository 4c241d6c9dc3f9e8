"""Structured Streaming over entries: an addition to the batch engine.

Rules that look at one entry alone run record by record; month counts use event time with a
watermark; duplicates meet in a stream-stream join bounded by the window. Rules that learn
from the population stay batch over the cumulative ledger: per micro-batch they would mean
something else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Ledger, enrich
from ..operators import rules as R
from ..schema import ENTRIES


def read_entries(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Entries as they arrive in a folder of Parquet files."""
    r = spark.readStream.schema(ENTRIES)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def record_flags(entries: DataFrame, ledger: Ledger) -> DataFrame:
    """Flags of the stateless rules R-001, R-004, R-006 and R-009 on a stream (or a batch)."""
    here = Ledger(entries, ledger.accounts, ledger.users, ledger.meta)
    rules = [R.UnbalancedEntry(), R.RoundAmount(), R.Description(), R.Approval()]
    return reduce(DataFrame.unionByName, [r.evaluate(here) for r in rules if r.applicable(here)[0]])


def month_counts(entries: DataFrame, lateness: str = "45 days") -> DataFrame:
    """(month, source, k): a row for each posting month and source, late entries within the
    watermark. The month's first instant is its event time, so a month closes once the
    watermark has passed it, which is lateness after the first entry of a later month."""
    e = enrich(entries).withColumn("month_start", F.date_trunc("month", F.to_timestamp("posting_date"))).withWatermark("month_start", lateness)
    monthly = e.groupBy("month_start", "source").agg(F.count("*").alias("k"))
    return monthly.select(F.date_format("month_start", "yyyy-MM").alias("month"), "source", "k")


def against_baseline(counts: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stream-static join: each month's counts beside the fixed baseline's (source, base_k,
    base_n)."""
    return counts.join(F.broadcast(baseline), "source", "left")


def duplicate_pairs(entries: DataFrame, window_days: int = 7, lateness: str = "45 days") -> DataFrame:
    """(first_id, second_id) of equal lines by one preparer within the window, as both
    arrive; state older than window and watermark is dropped."""
    sig = F.sha2(F.to_json(F.array_sort(F.transform("lines", lambda l: F.struct(l["account_id"], l["debit_cents"], l["credit_cents"])))), 256)  # noqa: E741
    e = entries.select("entry_id", "preparer_id", sig.alias("sig"), F.to_timestamp("posting_date").alias("at")).withWatermark("at", lateness)
    a = e.select(*[F.col(c).alias(f"a_{c}") for c in e.columns])
    b = e.select(*[F.col(c).alias(f"b_{c}") for c in e.columns])
    near = F.expr(f"b_at >= a_at - interval {window_days} days and b_at <= a_at + interval {window_days} days")
    j = a.join(b, (F.col("a_preparer_id") == F.col("b_preparer_id")) & (F.col("a_sig") == F.col("b_sig")) & near)
    return j.where("a_entry_id < b_entry_id").select(F.col("a_entry_id").alias("first_id"), F.col("b_entry_id").alias("second_id"))


def run_available(flags: DataFrame, out: str, checkpoint: str):
    """Process what is there, exactly once, and stop."""
    return flags.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
