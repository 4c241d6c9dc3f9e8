"""Aging of exceptions: months since the flagged entry was posted."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import months_apart
from ..model import Ledger, enrich


def bucket_labels(buckets: tuple[int, ...] = (0, 1, 2, 3)) -> list[str]:
    return [str(b) for b in buckets[:-1]] + [f"{buckets[-1]}+"]


def bucket(age: Column, buckets: tuple[int, ...] = (0, 1, 2, 3)) -> Column:
    out = None
    for low, label in reversed(list(zip(buckets, bucket_labels(buckets), strict=True))):
        out = F.when(age >= low, label) if out is None else out.when(age >= low, label)
    return out


@dataclass(frozen=True)
class AgingSchedule:
    as_of: str
    aged: DataFrame  # rule_id, entry_id, first_seen, age_months, bucket
    later: DataFrame  # the same of entries not yet posted
    buckets: tuple[int, ...] = (0, 1, 2, 3)

    @cached_property
    def n_not_yet_posted(self) -> int:
        return self.later.count()

    def by_rule(self) -> DataFrame:
        """A row a rule with aged flags, a column a bucket; counts are of flags."""
        labels = bucket_labels(self.buckets)
        return self.aged.groupBy("rule_id").pivot("bucket", labels).count().na.fill(0, labels)

    def by_bucket(self) -> DataFrame:
        return self.aged.groupBy("bucket").agg(F.count("*").alias("flags"), F.countDistinct("entry_id").alias("entries"))

    def oldest(self, k: int = 25) -> DataFrame:
        return self.aged.orderBy(F.desc("age_months"), "rule_id", "entry_id").limit(k)


def aged_flags(flags: DataFrame, entries: DataFrame, as_of: str, buckets: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Every flag with its entry's posting period and age; negative ages are not yet posted."""
    e = enrich(entries).select("entry_id", F.col("posting_period").alias("first_seen"))
    age = months_apart(F.col("first_seen"), F.lit(as_of))
    return flags.select("rule_id", "entry_id").join(e, "entry_id").select("rule_id", "entry_id", "first_seen", age.alias("age_months"), bucket(age, buckets).alias("bucket"))


def age_exceptions(flags: DataFrame, ledger: Ledger, as_of: str | None = None, buckets: tuple[int, ...] = (0, 1, 2, 3)) -> AgingSchedule:
    if as_of is None:
        as_of = enrich(ledger.entries).agg(F.max("posting_period")).first()[0]
        if as_of is None:
            raise ValueError("an empty ledger has no period to age to")
    every = aged_flags(flags, ledger.entries, as_of, buckets)
    if tuple(buckets) != tuple(sorted(set(buckets))) or not buckets or buckets[0] != 0:
        raise ValueError("buckets rise from zero")
    return AgingSchedule(as_of, every.where("age_months >= 0"), every.where("age_months < 0"), tuple(buckets))
