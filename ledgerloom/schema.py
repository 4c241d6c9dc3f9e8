"""Explicit schemas of the ledger tables, and their integrity checks as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCOUNT_TYPES = ("asset", "liability", "equity", "revenue", "expense")
SIDES = ("debit", "credit")
ROLES = ("preparer", "approver", "system")
DOCUMENT_TYPES = ("invoice", "credit_memo")

LINE = T.StructType([
    T.StructField("line_no", T.IntegerType()),
    T.StructField("account_id", T.StringType()),
    T.StructField("debit_cents", T.LongType()),
    T.StructField("credit_cents", T.LongType()),
])
DOCUMENT = T.StructType([
    T.StructField("doc_type", T.StringType()),
    T.StructField("party_id", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("doc_date", T.DateType()),
])
ACCOUNTS = T.StructType([
    T.StructField("account_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("normal_side", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("last_activity_before_range", T.DateType()),
])
USERS = T.StructType([
    T.StructField("user_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("role", T.StringType()),
])
ENTRIES = T.StructType([
    T.StructField("entry_seq", T.LongType(), False),
    T.StructField("entry_id", T.StringType(), False),
    T.StructField("posting_date", T.DateType()),
    T.StructField("effective_date", T.DateType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("preparer_id", T.StringType()),
    T.StructField("approver_id", T.StringType()),
    T.StructField("lines", T.ArrayType(LINE)),
    T.StructField("document", DOCUMENT),
])
MANIFEST = T.StructType([
    T.StructField("seed", T.LongType()),
    T.StructField("anomaly_id", T.StringType()),
    T.StructField("anomaly_class", T.StringType()),
    T.StructField("entry_ids", T.ArrayType(T.StringType())),
    T.StructField("note", T.StringType()),
])
FLAGS = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("entry_id", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("details", T.StringType()),
])


def line_faults(entries: DataFrame) -> DataFrame:
    """(entry_id, fault) of every structural fault: no lines, a negative side, or a line
    whose debit and credit are not exactly one positive amount. Unbalanced entries, blank
    descriptions and self-approval are legal: the rules look for those."""
    one_sided = "((l.debit_cents > 0) = (l.credit_cents > 0)) or l.debit_cents < 0 or l.credit_cents < 0"
    fault = F.when(F.coalesce(F.size("lines"), F.lit(0)) < 1, "no lines").when(F.expr(f"exists(lines, l -> coalesce({one_sided}, true))"), "a line needs exactly one positive side")
    return entries.select("entry_id", fault.alias("fault")).where("fault is not null")


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def domain_faults(accounts: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(key, fault) of values outside the model's domains."""
    a = accounts.select(
        F.col("account_id").alias("key"),
        F.when(F.coalesce(F.col("account_id"), F.lit("")) == "", "empty account id")
        .when(~F.col("type").isin(*ACCOUNT_TYPES), "unknown account type")
        .when(~F.col("normal_side").isin(*SIDES), "unknown normal side").alias("fault"),
    )
    if users is not None:
        a = a.unionByName(users.select(F.col("user_id").alias("key"), F.when(~F.col("role").isin(*ROLES), "unknown role").alias("fault")))
    return a.where("fault is not null")
