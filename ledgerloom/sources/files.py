"""Reading and writing ledgers: Parquet tables natively, one JSON object and CSV lines for
interchange, and the flag, manifest and summary files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cents_to_str
from ..model import Ledger
from ..schema import ACCOUNTS, DOCUMENT, ENTRIES, LINE, MANIFEST, USERS


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, ASCII; numbers that JSON lacks are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def canonical_bytes(value: Any) -> bytes:
    return canonical_json(value).encode("ascii")


def write_text(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8", newline="\n")


def write_json(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_json_compact(path: str | Path, value: Any) -> None:
    write_text(path, json.dumps(value, sort_keys=True, separators=(",", ":"), default=str) + "\n")


# Parquet: the native layout


def write_parquet(ledger: Ledger, folder: str, by_period: bool = False) -> None:
    """entries/, accounts/, users/ and meta/ under the folder; by_period partitions the
    entries by posting month, so that continuous runs read the months they need."""
    e = ledger.entries
    if by_period:
        e.withColumn("posting_month", F.date_format("posting_date", "yyyy-MM")).write.mode("overwrite").partitionBy("posting_month").parquet(f"{folder}/entries")
    else:
        e.write.mode("overwrite").parquet(f"{folder}/entries")
    ledger.accounts.write.mode("overwrite").parquet(f"{folder}/accounts")
    if ledger.users is not None:
        ledger.users.write.mode("overwrite").parquet(f"{folder}/users")
    spark = e.sparkSession
    spark.createDataFrame([(canonical_json(ledger.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def read_parquet(spark: SparkSession, folder: str) -> Ledger:
    e = spark.read.parquet(f"{folder}/entries").drop("posting_month")
    try:
        users = spark.read.parquet(f"{folder}/users")
    except Exception as error:  # a ledger without users
        if "PATH_NOT_FOUND" not in str(error):
            raise
        users = None
    meta = json.loads(spark.read.text(f"{folder}/meta").first()["value"])
    return Ledger(e, spark.read.parquet(f"{folder}/accounts"), users, meta)


# JSON: one object with meta, coa, users and entries


def read_json(spark: SparkSession, path: str) -> Ledger:
    """A folder with ledger.json, or the file. Dates are ISO text; a missing document is
    null. The order of the array is the ledger's order."""
    file = path if path.endswith(".json") else f"{path.rstrip('/')}/ledger.json"
    line = "struct<account_id:string,debit_cents:bigint,credit_cents:bigint>"
    entry = f"struct<entry_id:string,posting_date:string,effective_date:string,description:string,source:string,preparer_id:string,approver_id:string,lines:array<{line}>,document:struct<doc_type:string,party_id:string,reference:string,doc_date:string>>"
    account = "struct<account_id:string,name:string,type:string,normal_side:string,active:boolean,last_activity_before_range:string>"
    raw = spark.read.schema(f"meta string, coa array<{account}>, users array<struct<user_id:string,name:string,role:string>>, entries array<{entry}>").option("multiLine", True).json(file)
    meta = raw.select("meta").first()["meta"]
    e = raw.select(F.posexplode("entries").alias("entry_seq", "e")).select(F.col("entry_seq").cast("bigint").alias("entry_seq"), "e.*")
    lines = F.transform("lines", lambda l, i: F.struct((i + 1).cast("int").alias("line_no"), l["account_id"].alias("account_id"), F.coalesce(l["debit_cents"], F.lit(0)).alias("debit_cents"), F.coalesce(l["credit_cents"], F.lit(0)).alias("credit_cents")))  # noqa: E741
    doc = F.when(F.col("document").isNotNull(), F.struct("document.doc_type", "document.party_id", "document.reference", F.col("document.doc_date").cast("date").alias("doc_date")))
    e = e.select("entry_seq", "entry_id", F.col("posting_date").cast("date").alias("posting_date"), F.col("effective_date").cast("date").alias("effective_date"), "description", "source", "preparer_id", "approver_id", lines.cast(f"array<{LINE.simpleString()}>").alias("lines"), doc.cast(DOCUMENT).alias("document"))
    a = raw.select(F.explode("coa").alias("a")).select("a.*").withColumn("last_activity_before_range", F.col("last_activity_before_range").cast("date"))
    return Ledger(e, a, raw.select(F.explode("users").alias("u")).select("u.*"), json.loads(meta) if meta else {})


def _clean(v):
    """A row's value as the JSON form has it."""
    if isinstance(v, dict):
        return {k: _clean(x) for k, x in v.items() if k not in ("line_no", "entry_seq") and not (k in ("document", "last_activity_before_range") and x is None)}
    if isinstance(v, list):
        return [_clean(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


def ledger_dict(ledger: Ledger) -> dict:
    """The JSON object of a small ledger; collects it."""
    rows = lambda df: [_clean(r.asDict(True)) for r in df.collect()]
    return {"meta": _clean(dict(ledger.meta)), "coa": rows(ledger.accounts.orderBy("account_id")), "users": rows(ledger.users.orderBy("user_id")) if ledger.users is not None else [], "entries": rows(ledger.entries.orderBy("entry_seq"))}


def write_ledger_json(ledger: Ledger, path: str | Path) -> None:
    """The JSON object of a ledger of any size: entries pass one at a time, in order."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    small = ledger_dict(Ledger(ledger.entries.limit(0), ledger.accounts, ledger.users, ledger.meta))
    plain = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), default=str)
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write('{"coa":' + plain(small["coa"]) + ',"entries":[')
        for i, r in enumerate(ledger.entries.orderBy("entry_seq").toLocalIterator(prefetchPartitions=True)):
            out.write(("," if i else "") + plain(_clean(r.asDict(True))))
        out.write('],"meta":' + plain(small["meta"]) + ',"users":' + plain(small["users"]) + "}\n")


# CSV: one row a line


def csv_rows(ledger: Ledger) -> DataFrame:
    """The 17 text columns; what is missing, and the side without an amount, is empty."""
    e = ledger.entries.select("*", F.explode("lines").alias("l"))
    e = e.join(F.broadcast(ledger.accounts.select(F.col("account_id").alias("__a"), F.col("name").alias("__n"))), F.col("l.account_id") == F.col("__a"), "left")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    side = lambda c: F.when(F.col(c) > 0, cents_to_str(F.col(c))).otherwise("")
    return e.select(
        "entry_seq", text(F.col("entry_id")).alias("entry_id"), text(F.col("posting_date")).alias("posting_date"), text(F.col("effective_date")).alias("effective_date"),
        text(F.date_format("effective_date", "yyyy-MM")).alias("period"), *[text(F.col(c)).alias(c) for c in ("source", "preparer_id", "approver_id", "description")],
        text(F.col("l.line_no")).alias("line_no"), text(F.col("l.account_id")).alias("account_id"), text(F.col("__n")).alias("account_name"),
        side("l.debit_cents").alias("debit"), side("l.credit_cents").alias("credit"),
        text(F.col("document.doc_type")).alias("doc_type"), text(F.col("document.party_id")).alias("doc_party"), text(F.col("document.reference")).alias("doc_reference"), text(F.col("document.doc_date")).alias("doc_date"),
    )


def write_csv(ledger: Ledger, folder: str) -> None:
    csv_rows(ledger).sortWithinPartitions("entry_seq", "line_no").drop("entry_seq").write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").csv(folder)


# flags and manifests


def write_flags(flags: DataFrame, status: DataFrame, folder: str) -> None:
    flags.write.mode("overwrite").partitionBy("rule_id").parquet(f"{folder}/flags")
    status.write.mode("overwrite").parquet(f"{folder}/status")


def write_flags_json(ledger: Ledger, flags: DataFrame, status: DataFrame, path: str | Path) -> None:
    """The flags file of a run of any size: flags pass one at a time, rule by rule."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    said = {r["rule_id"]: r for r in status.collect()}
    counts = {r["rule_id"]: r["n"] for r in flags.groupBy("rule_id").agg(F.count("*").alias("n")).collect()}
    rows = iter(flags.orderBy("rule_id", "entry_id", "details").toLocalIterator(prefetchPartitions=True))
    plain = lambda v: json.dumps(v, sort_keys=True, default=str)
    row = next(rows, None)
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write('{"ledger_meta": ' + plain(ledger.meta) + ', "results": {')
        for i, (k, s) in enumerate(sorted(said.items())):
            head = plain({"applicable": s["applicable"], "n_flags": counts.get(k, 0), "population_size": s["population_size"], "reason": s["reason"], "rule_id": k})
            out.write((",\n" if i else "\n") + plain(k) + ": " + head[:-1] + ', "flags": [')
            first = True
            while row is not None and row["rule_id"] == k:
                out.write(("" if first else ",") + "\n" + plain({"rule_id": k, "entry_id": row["entry_id"], "rationale": row["rationale"], "details": json.loads(row["details"])}))
                first, row = False, next(rows, None)
            out.write("]}")
        out.write("}}\n")


def battery_dict(ledger: Ledger, flags: DataFrame, status: DataFrame) -> dict:
    """The flags file of a small run; collects it."""
    by: dict[str, list] = {}
    for r in flags.orderBy("rule_id", "entry_id", "details").collect():
        by.setdefault(r["rule_id"], []).append({"rule_id": r["rule_id"], "entry_id": r["entry_id"], "rationale": r["rationale"], "details": json.loads(r["details"])})
    results = {s["rule_id"]: {"applicable": s["applicable"], "reason": s["reason"], "population_size": s["population_size"], "n_flags": len(by.get(s["rule_id"], [])), "flags": by.get(s["rule_id"], [])} for s in status.collect()}
    return {"ledger_meta": ledger.meta, "results": results}


def manifest_dict(manifest: DataFrame, plan: dict, generator_seed: int, anomaly_seed: int) -> dict:
    rows = [{"anomaly_id": r["anomaly_id"], "anomaly_class": r["anomaly_class"], "entry_ids": list(r["entry_ids"]), "note": r["note"]} for r in manifest.orderBy("anomaly_id").collect()]
    return {"generator_seed": generator_seed, "anomaly_seed": anomaly_seed, "plan": plan, "n_anomalies": len(rows), "n_planted_entries": len({e for r in rows for e in r["entry_ids"]}), "anomalies": rows}


def manifest_from_dict(spark: SparkSession, d: dict) -> DataFrame:
    rows = [(d["generator_seed"], a["anomaly_id"], a["anomaly_class"], a["entry_ids"], a["note"]) for a in d["anomalies"]]
    return spark.createDataFrame(rows, MANIFEST)


__all__ = ["ACCOUNTS", "ENTRIES", "USERS"]
