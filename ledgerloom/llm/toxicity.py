"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, trimmed, utf8
from .nbsvm import SAMPLE_ROWS, Model, char_ngrams, score_documents, train_model


def train_toxicity(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labels.toxic of rows outside the fold; at most `sample_rows` of them."""
    return train_model(documents, labels, "toxic", char_ngrams, fold, sample_rows=sample_rows, most=6000)


def toxicity_scores(documents: DataFrame, labels: DataFrame, fold: tuple[int, int] = (4, 2), threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of documents.

    Nulls: a null text scores as an empty one; a null doc_id is not held out and never
    trains. Repeated rows and ids: each row gets its score. Empty documents: no rows. No
    labels, or labels of one class: a constant score (0.5 without labels). Other columns of
    either table are neither read nor returned.
    """
    model = train_toxicity(documents, labels, fold, sample_rows)
    scored = score_documents(documents, model)
    return scored.select(
        "doc_id",
        in_fold("doc_id", *fold).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: tuple[int, int] = (4, 2), text: str = "text") -> DataFrame:
    """The rows of documents that score below the threshold, all columns as they came: the
    score is taken beside the rows in the same map, so nothing is joined or shuffled."""
    model = train_toxicity(documents, labels, fold)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            yield batch.filter(pa.array(m.score(raw, offsets) < threshold))

    return documents.mapInArrow(trimmed(run), documents.schema)
