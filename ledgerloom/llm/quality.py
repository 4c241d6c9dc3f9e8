"""Quality classifier: naive Bayes support vectors over word-form n-gram indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold
from .nbsvm import SAMPLE_ROWS, Model, form_ngrams, score_documents, train_model


def train_quality(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labels.quality of rows outside the fold; at most `sample_rows` of them."""
    return train_model(documents, labels, "quality", form_ngrams, fold, sample_rows=sample_rows)


def quality_scores(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents.

    Nulls: a null text scores as an empty one; a null doc_id is not held out and never
    trains. Repeated rows and ids: each row gets its score. Empty documents: no rows. No
    labels, or labels of one class: a constant score (0.5 without labels). Other columns of
    either table are neither read nor returned.
    """
    model = train_quality(documents, labels, fold, sample_rows)
    scored = score_documents(documents, model)
    return scored.select(
        "doc_id",
        in_fold("doc_id", *fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
