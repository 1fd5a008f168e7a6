"""A corpus pipeline of five stages over the table documents; each takes (spark, docs, sf_dir).

Each stage but the last keeps the columns of documents, and each works on all that the one before it
kept. The classifier and the decontamination read the tables labels and benchmark of sf_dir.

In all stages texts are worked on whole, however long; rows with equal ids are rows of their own; columns beyond id and text pass
through under any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickwarden.llm.common import fresh_path, table
from tickwarden.llm.decontaminate import drop_contaminated
from tickwarden.llm.neardup import one_of_each
from tickwarden.llm.packing import best_fit_sequences
from tickwarden.llm.pii import replace_private_data
from tickwarden.llm.quality import keep_good
from tickwarden.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier rejects. Null texts count as empty and are scored as such; equal texts have one score and share their fate; where there is nothing to learn from all are kept."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class, the one with the smallest id (null ids last). Null and empty texts are one class; repeated rows keep one."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Null and empty texts hold none; items of fewer than five words are no items; repeated rows go or stay alike."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data. A null text stays null; equal texts change alike, so repeated rows stay repeated; of entities that draw one surrogate the least keeps it."""
    return replace_private_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences. Null and empty texts are the end id alone; longer documents are cut; ties go by id; repeated rows are packed each."""
    return best_fit_sequences(docs, vocabulary_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("packing", packing),
]

#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := fresh_path(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
