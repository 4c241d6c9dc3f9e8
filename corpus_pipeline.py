"""A training corpus in five stages: rules, toxicity, near copies, mixing, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the rows
that the next stage gets as docs. All but the last keep the columns of documents. Stage
results are Parquet tables in the shared work folder, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import public_path
from ledgerloom.llm.common import materialize
from ledgerloom.llm.mixing import mix_rows
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.rules import keep_good
from ledgerloom.llm.tgm_join import one_of_each
from ledgerloom.llm.toxicity import drop_toxic


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps."""
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the model trained on labelled ones."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle links at 0.8."""
    return one_of_each(docs, 5, 80, one_an_id=False)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048."""
    return pack_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("near copies", near_copies), ("mixing", mixing), ("packing", packing)]

#: A trained model and token ids: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
