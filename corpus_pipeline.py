"""The corpus pipeline: five stages, each working on all that the stage before kept.

Quality classifier, near-duplicates, repeated passages, benchmark decontamination, tokenizing.
All stages but the last return whole rows of ``documents``; the last returns one row of token
counts and digests for each document that is left.  Every stage reads whole texts of any length,
takes null and empty texts, null and repeated ids and columns of any name, keeps them or lets them
go by the rule that it states, and gives no rows for none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bpe import encode_documents
from ledgerloom.llm.common import materialize, read_table
from ledgerloom.llm.decontaminate import remove_contamination
from ledgerloom.llm.neardup import keep_one_each
from ledgerloom.llm.quality import fit_quality, keep_quality
from ledgerloom.llm.suffix import remove_repeats


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those with a score of at least 0.5.

    Texts without words are scored as such; repeated rows share their fate; without labels all stay.
    """
    machine = fit_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "quality")
    return keep_quality(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the least doc_id.

    Documents without words stay; of rows with the same doc_id and text one stays; a null doc_id
    stays only where its group has no other.
    """
    return keep_one_each(docs, words=5, similarity="4/5")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that came before; those with nothing left go.

    Earlier is by doc_id, nulls first, equal ids by a hash of their texts.  Null and empty texts stay.
    """
    return remove_repeats(docs, threshold=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go.

    That is over 200 hit words or over half of all.  Null and empty texts stay; no benchmark, no change.
    """
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents, encoded and decoded; a null text has no tokens."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cached=300_000, piece=1 << 20)


STAGES = [
    ("quality", classify),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("tokens", tokenize),
]

#: The quality model, signatures and merges have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
