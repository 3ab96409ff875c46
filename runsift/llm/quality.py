"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL, scored as sparse dot products.

Labels are learned from at most `SAMPLE` labelled rows outside the held-out fold,
those with the lowest id hashes; training on them takes place on the driver, as
the updates follow each other. All documents are scored in their tasks.

Edge cases: null and empty texts have no features and get the intercept's score;
labels that are null or of unknown documents are ignored, several labels of a document count by
their majority (ties: 1); without any label to learn from all scores are 0.5;
repeated rows are scored alike; an empty table gives no rows; further columns
are ignored by the classifier and passed through by the filter, whose own
column is `_quality`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from runsift.llm.common import fold, sample_ids
from runsift.llm.hashed import WIDTH, ftrl, scores, shares, training_rows

FOLDS, THRESHOLD = 5, 0.3
SAMPLE = 4000


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(id, text, label) of a bounded sample outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias(label))
    picked = F.broadcast(sample_ids(known, "id", sample))  # at most `sample` rows
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id").dropDuplicates(["id"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = training_rows(labelled(docs, labels, label, id_col, text_col, sample), label, shares)
    return ftrl(rows) if len(rows) else (np.zeros(WIDTH, np.float32), 0.0)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights, intercept = train(docs, labels, "quality", id_col, text_col, sample)
    scored = scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), weights, intercept, shares)
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that score at least the threshold, unchanged."""
    weights, intercept = train(docs, labels, "quality", id_col, text_col, sample)
    names = docs.columns
    copied = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), F.col(text_col).alias("text"))
    kept = scores(copied, weights, intercept, shares).where(F.col("score") >= threshold)
    return kept.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)])
