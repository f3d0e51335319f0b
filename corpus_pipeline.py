"""A corpus pipeline over the documents table: quality rules, exact dedup, near-duplicate join, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.llm import exact_dedup, ngram_join, pii, quality_rules
from lexigrove.llm.queries import packed_documents
from lexigrove.session import shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the rules or the likelihood ratio reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked documents the least id stays."""
    return ngram_join.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: personal data and what reveals it are replaced in the texts; n_chars stays that of the original."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: where each piece of each document lies in sequences of 2048 tokens."""
    return packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good_documents),
    ("exact_dedup", distinct_texts),
    ("ngram_join", one_of_near_duplicates),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: SQL can express neither the near-duplicate join's method nor the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
