"""Batteries of rules and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Ledger, enrich
from . import rules as R
from .drift import ProfileDrift

GENERAL = (R.UnbalancedEntry, R.PeriodEnd, R.WeekendHoliday, R.RoundAmount, R.BelowThreshold, R.Description, R.DormantAccount, R.RarePairing, R.Approval, R.Duplicate, R.NearDuplicate)
CONTINUOUS = (ProfileDrift,)
PAYABLES = (R.DocumentKey, R.AmountAndDate)


def default_rules() -> list[R.Rule]:
    return [c() for c in GENERAL]


def continuous_rules() -> list[R.Rule]:
    return [c() for c in CONTINUOUS]


def ap_rules() -> list[R.Rule]:
    return [c() for c in PAYABLES]


BATTERIES = {"default": default_rules, "ap": ap_rules, "continuous": continuous_rules}


def rule_class_by_id() -> dict[str, type[R.Rule]]:
    return {c.rule_id: c for c in (*GENERAL, *CONTINUOUS, *PAYABLES)}


def build_rules(ids: list[str]) -> list[R.Rule]:
    known = rule_class_by_id()
    wrong = [i for i in ids if i not in known]
    if wrong:
        raise ValueError(f"unknown rules {wrong}; there are {sorted(known)}")
    return [known[i]() for i in ids]


def evaluate_all(ledger: Ledger, rules: list[R.Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, status): flags of every rule as one lazy DataFrame, and a row a rule
    (rule_id, applicable, reason, population_size). A refusal is a result, not an error."""
    spark = ledger.entries.sparkSession
    rules = default_rules() if rules is None else rules
    said = [r.applicable(ledger) for r in rules]
    # the sizes of populations that are conditions on entries, in one pass over these
    plain = [i for i, (r, (ok, _)) in enumerate(zip(rules, said, strict=True)) if ok and type(r).population is R.Rule.population and type(r).population_size is R.Rule.population_size]
    sizes = {}
    if plain:
        got = enrich(ledger.entries).agg(*[F.count_if(rules[i].in_population(ledger)).alias(f"n{i}") for i in plain]).first()
        sizes = {i: got[f"n{i}"] for i in plain}
    status = [(r.rule_id, ok, why, sizes[i] if i in sizes else r.population_size(ledger) if ok else 0) for i, (r, (ok, why)) in enumerate(zip(rules, said, strict=True))]
    flags = [r.evaluate(ledger) for r, s in zip(rules, status, strict=True) if s[1]]
    none = spark.createDataFrame([], "rule_id string, entry_id string, rationale string, details string")
    return reduce(DataFrame.unionByName, flags, none), spark.createDataFrame(status, "rule_id string, applicable boolean, reason string, population_size long")


def sort_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy("entry_id", "rule_id", "details")


def flatten_flags(flags: DataFrame) -> DataFrame:
    return flags.orderBy("rule_id", "entry_id", "details")


def distinct_entries(flags: DataFrame) -> DataFrame:
    return flags.select("entry_id").distinct()


def flags_by_rule(flags: DataFrame) -> DataFrame:
    return flags.groupBy("rule_id").agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("flags"))
