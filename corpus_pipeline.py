"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
between stages the documents are written as Parquet. Null and empty texts, repeated
rows and empty tables go through as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runsift.llm.common import saved, stored
from runsift.llm.decontam import decontaminated
from runsift.llm.jaccard import one_of_each
from runsift.llm.line_dedup import without_shared_lines
from runsift.llm.packing import pack
from runsift.llm.quality import of_quality
from runsift.llm.queries import ENTRIES, tokenizer_path
from runsift.workload.registry import Entry


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this stage's documents, rejects go."""
    return of_quality(docs, stored(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay in the first document only; n_chars follows the text."""
    out = without_shared_lines(docs)
    n_chars = F.when(F.col("_line_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminated(docs, stored(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: The classifier is trained step by step and token ids are not SQL's; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ENTRIES["pipeline"] = Entry(run, ORACLE_SQL)

__all__ = ["ENTRIES", "ORACLE_SQL", "STAGES", "run"]
