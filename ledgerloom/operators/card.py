"""Report card: recall, precision and false positives against planted truth. Every table has
a seed column, so all seeds are graded in one job and pooled by summing counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import HIGHER, LOWER, Decision, decide, proportion
from ..model import Ledger
from .registry import default_rules, evaluate_all


@dataclass(frozen=True)
class Targets:
    recall: float = 0.9
    precision: float = 0.5
    fp_rate: float = 0.02
    min_sample: int = 20


def designed(spark, rules) -> DataFrame:
    """(rule_id, anomaly_class): which rule is meant for which class."""
    rows = [(r.rule_id, t) for r in rules for t in r.targets]
    return spark.createDataFrame(rows, "rule_id string, anomaly_class string")


def instances(manifest: DataFrame, flags: DataFrame, meant: DataFrame) -> DataFrame:
    """(seed, anomaly_id, anomaly_class, detected, by_design, caught_by) of every planted
    instance: detected if any rule flags any of its entries."""
    m = manifest.select("seed", "anomaly_id", "anomaly_class", F.explode("entry_ids").alias("entry_id"))
    f = flags.select("seed", "rule_id", "entry_id").distinct()
    hit = m.join(f, ["seed", "entry_id"], "left").join(F.broadcast(meant.withColumn("meant", F.lit(True))), ["rule_id", "anomaly_class"], "left")
    return hit.groupBy("seed", "anomaly_id", "anomaly_class").agg(
        F.max(F.col("rule_id").isNotNull()).alias("detected"),
        F.coalesce(F.max(F.col("meant")), F.lit(False)).alias("by_design"),
        F.array_sort(F.collect_set("rule_id")).alias("caught_by"),
    )


def recall_by_class(inst: DataFrame) -> DataFrame:
    """(anomaly_class, planted, detected, by_design, lowest, highest): pooled over seeds;
    lowest and highest are single seeds' recalls."""
    seeds = inst.groupBy("anomaly_class", "seed").agg(F.count("*").alias("n"), F.count_if("detected").alias("d"), F.count_if("by_design").alias("b"))
    return seeds.groupBy("anomaly_class").agg(F.sum("n").alias("planted"), F.sum("d").alias("detected"), F.sum("b").alias("by_design"), F.min(F.col("d") / F.col("n")).alias("lowest"), F.max(F.col("d") / F.col("n")).alias("highest"))


def entry_marks(entry_counts: DataFrame, manifest: DataFrame, flags: DataFrame) -> DataFrame:
    """(seed, n, planted, flagged, flagged_planted) at entry level."""
    p = manifest.select("seed", F.explode("entry_ids").alias("entry_id")).distinct().withColumn("p", F.lit(1))
    f = flags.select("seed", "entry_id").distinct().withColumn("f", F.lit(1))
    both = p.join(f, ["seed", "entry_id"], "full")
    c = both.groupBy("seed").agg(F.count("p").alias("planted"), F.count("f").alias("flagged"), F.count_if(F.col("p").isNotNull() & F.col("f").isNotNull()).alias("flagged_planted"))
    return entry_counts.join(c, "seed", "left").na.fill(0, ["planted", "flagged", "flagged_planted"])


def rule_yield(manifest: DataFrame, flags: DataFrame) -> DataFrame:
    """(rule_id, flagged, planted) distinct entries, pooled over seeds."""
    p = manifest.select("seed", F.explode("entry_ids").alias("entry_id")).distinct().withColumn("p", F.lit(1))
    f = flags.select("seed", "rule_id", "entry_id").distinct()
    return f.join(p, ["seed", "entry_id"], "left").groupBy("rule_id").agg(F.count("*").alias("flagged"), F.count("p").alias("planted"))


@dataclass(frozen=True)
class ReportCard:
    seeds: list[int]
    classes: list[dict]
    rules: list[dict]
    precision: Decision
    fp_rate: Decision
    recall: dict[str, Decision]
    targets: Targets = field(default_factory=Targets)

    def to_dict(self) -> dict:
        def d(x: Decision) -> dict:
            m = x.measurement
            return {"outcome": x.outcome, "reason": x.reason, "value": round(m.value, 6), "k": m.numerator, "n": m.n, "interval": [round(m.low, 6), round(m.high, 6)]}

        return {"seeds": self.seeds, "recall": {k: d(v) for k, v in self.recall.items()}, "precision": d(self.precision), "fp_rate": d(self.fp_rate), "classes": self.classes, "rules": self.rules}


def grade(entry_counts: DataFrame, manifest: DataFrame, flags: DataFrame, rules, seeds: list[int], targets: Targets = Targets()) -> ReportCard:
    """entry_counts: (seed, n)."""
    spark = flags.sparkSession
    inst = instances(manifest, flags, designed(spark, rules))
    classes = [r.asDict() for r in recall_by_class(inst).orderBy("anomaly_class").collect()]
    for c in classes:
        c["designed_rules"] = sorted(r.rule_id for r in rules if c["anomaly_class"] in r.targets)
    totals = entry_marks(entry_counts, manifest, flags).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "planted", "flagged", "flagged_planted")]).first()
    recall = {c["anomaly_class"]: decide(proportion(f"recall {c['anomaly_class']}", c["detected"], c["planted"], HIGHER), targets.recall, targets.min_sample) for c in classes}
    precision = decide(proportion("precision", totals["flagged_planted"], totals["flagged"], HIGHER), targets.precision, targets.min_sample)
    clean = totals["n"] - totals["planted"]
    fp = decide(proportion("false positives", totals["flagged"] - totals["flagged_planted"], clean, LOWER), targets.fp_rate, targets.min_sample)
    return ReportCard(seeds, classes, [r.asDict() for r in rule_yield(manifest, flags).orderBy("rule_id").collect()], precision, fp, recall, targets)


def build_report_card(spark, seeds: list[int], plant: Callable[[int], tuple[Ledger, DataFrame]], rules=None, targets: Targets = Targets()) -> ReportCard:
    """plant(seed) -> (ledger, manifest). Rules learn from one ledger at a time, so each seed
    is a ledger of its own; flags and manifests of all seeds are graded together."""
    if not seeds or len(set(seeds)) != len(seeds):
        raise ValueError("seeds are distinct, and there is one at least")
    rules = default_rules() if rules is None else rules
    flags = manifests = counts = None
    for s in seeds:
        ledger, manifest = plant(s)
        f, _ = evaluate_all(ledger, rules)
        f = f.withColumn("seed", F.lit(s))
        m = manifest.withColumn("seed", F.lit(s))
        c = ledger.entries.agg(F.count("*").alias("n")).withColumn("seed", F.lit(s))
        flags, manifests, counts = (x if y is None else y.unionByName(x) for x, y in ((f, flags), (m, manifests), (c, counts)))
    return grade(counts, manifests, flags.cache(), rules, list(seeds), targets)
