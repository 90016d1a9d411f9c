"""A training corpus from `documents`: quality, exact and near deduplication, decontamination, tokens.

Every stage takes documents as they come: null texts count as empty, null ids and repeated rows are
allowed, texts may have any length, further columns (also those named like a stage's own) are passed
on, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, quality
from marlstone.llm.shared import bounded_batches, drop_tables, materialise, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text the quality network scores 0.7 or more. It learns from the labelled documents given.

    Null and empty texts are scored like others; repeated rows share a score and so stay or go together.
    """
    bounded_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id.

    Null and empty texts are equal. A row without an id stays only if no other row has its text; of rows
    with one id and text one stays.
    """
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles the one with the smallest doc_id.

    Documents without words and rows without an id stay; of rows with one id and text one stays.
    """
    bounded_batches(spark)
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts have none, repeated rows stay or go together."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and digests of ids and of the text that decoding gives; null and empty texts have no tokens."""
    bounded_batches(spark)
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", exact_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: SQL has neither the network nor BPE; the stages are tested one by one and together against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; each is written as Parquet and read again before the next, which then lets the one before it go."""
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        made: list[str] = []
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"), made)
        drop_tables(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
