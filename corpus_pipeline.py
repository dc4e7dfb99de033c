"""Corpus preparation: quality rules, near-duplicates, decontamination, personal data, packing.

Every stage takes what the one before it kept, written as Parquet and read again. All but the last return the columns
of documents. Null texts fail the quality rules; rows without doc_id are treated as others.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cutflow.llm.common import staged, table
from cutflow.llm.decontaminate import decontaminate
from cutflow.llm.neardup import distinct_documents
from cutflow.llm.packing import packed_documents, tokenizer_file
from cutflow.llm.pii import redact
from cutflow.llm.quality import quality_rules

#: The stages cannot be expressed in SQL together; tests hold them against plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, table(spark, sf_dir, "labels")).where("kept").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near-duplicates: the one with the smallest id. Five-word shingles, Jaccard 0.8.

    Equal rows are one. An id that occurs with several texts joins nothing, so no text is lost for its id."""
    return distinct_documents(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("kept").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a training sequence."""
    return packed_documents(docs, tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
