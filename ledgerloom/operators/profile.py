"""Population profile: composition tallies, scalars, deciles and the largest amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..model import Ledger, enrich

#: Category of an entry in each dimension that counts entries.
ENTRY_DIMENSIONS: dict[str, Column] = {}


def entry_dimensions() -> dict[str, Column]:
    return {
        "by_weekday": F.weekday("posting_date").cast("string"),
        "by_month": F.col("posting_period"),
        "by_source": F.col("source"),
        "by_preparer": F.col("preparer_id"),
    }


def composition(entries: DataFrame, by: list[str] | None = None, dimensions: list[str] | None = None) -> DataFrame:
    """(by..., dimension, category, k): one pass over the entries for all entry dimensions,
    zero-filled weekdays, and by_account over lines."""
    by = by or []
    e = enrich(entries)
    kinds = entry_dimensions()
    chosen = [d for d in (dimensions or [*kinds, "by_account"]) if d in kinds]
    wrong = [d for d in (dimensions or []) if d not in kinds and d != "by_account"]
    if wrong:
        raise ValueError(f"unknown dimensions {wrong}")
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), kinds[d].alias("category")) for d in chosen])) if chosen else None
    out = None
    if chosen:
        out = e.select(*by, cells.alias("c")).groupBy(*by, "c.dimension", "c.category").agg(F.count("*").alias("k"))
    if not by and "by_weekday" in chosen:
        days = e.sparkSession.range(7).select(F.lit("by_weekday").alias("dimension"), F.col("id").cast("string").alias("category"), F.lit(0).cast("bigint").alias("k"))
        out = out.unionByName(days).groupBy("dimension", "category").agg(F.sum("k").alias("k"))
    if dimensions is None or "by_account" in dimensions:
        lines = e.select(*by, F.explode("lines.account_id").alias("category"), F.lit("by_account").alias("dimension")).groupBy(*by, "dimension", "category").agg(F.count("*").alias("k"))
        out = lines if out is None else out.unionByName(lines)
    return out


def with_totals(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds n, the dimension's total: the sum of its tally."""
    return cells.withColumn("n", F.sum("k").over(W.partitionBy(*(by or []), "dimension")))


def scalars(ledger: Ledger) -> DataFrame:
    """One row of counts; approval tallies only where a threshold is declared."""
    t = ledger.meta.get("approval_threshold_cents")
    e = enrich(ledger.entries)
    need = (F.col("source") == "GL") | (F.col("amount_cents") >= t) if t is not None else F.lit(None).cast("boolean")
    return e.agg(
        F.count("*").alias("n_entries"),
        F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.min("posting_date").cast("string"), F.lit("")).alias("first_posting"),
        F.coalesce(F.max("posting_date").cast("string"), F.lit("")).alias("last_posting"),
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_amount_cents"),
        (F.count_if(need) if t is not None else F.lit(None).cast("bigint")).alias("requiring_approval"),
        (F.count_if(need & F.col("approver_id").isNull()) if t is not None else F.lit(None).cast("bigint")).alias("missing_approval"),
    )


def deciles(values: DataFrame, column: str) -> DataFrame:
    """(q, value) for q = 0..10: the value at place round_half_even(q * (n - 1) / 10) of the
    sorted values. Equal values are counted first, and places come from block offsets, so no
    task sorts all rows."""
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    # values in blocks of nearby ones: running counts inside a block, then over the blocks
    counted = counted.withColumn("block", F.floor(F.log2(F.greatest(F.abs(F.col("value").cast("double")), F.lit(1.0))) * 64) * F.signum(F.col("value").cast("double")))
    inner = W.partitionBy("block").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    blocks = counted.groupBy("block").agg(F.sum("c").alias("bc"))
    outer = W.partitionBy(F.lit(1)).orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a few thousand blocks
    blocks = blocks.select("block", F.coalesce(F.sum("bc").over(outer), F.lit(0)).alias("before"), F.sum("bc").over(W.partitionBy(F.lit(1))).alias("n"))
    spans = counted.withColumn("low", F.coalesce(F.sum("c").over(inner), F.lit(0))).join(blocks, "block").withColumn("low", F.col("low") + F.col("before"))
    q = values.sparkSession.range(11).select(F.col("id").cast("int").alias("q"))
    place = F.bround(F.col("q") * (F.col("n") - 1) / F.lit(10.0), 0).cast("bigint")
    return spans.join(F.broadcast(q), (place >= F.col("low")) & (place < F.col("low") + F.col("c"))).select("q", "value")


def top_amounts(ledger: Ledger, k: int = 5) -> DataFrame:
    return enrich(ledger.entries).select("entry_id", "amount_cents").orderBy(F.desc("amount_cents"), "entry_id").limit(k)
