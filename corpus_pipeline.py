"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, byte-level BPE.

Every stage takes what its predecessor kept and returns the columns of documents; the last returns one row for each
document that the mix trains on, as often as it does, with its token count and digests, in training order (position).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, mixing, near_duplicates, pii, quality_rules
from factloom.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the base rules or the learned decision list reject."""
    return quality_rules.filter_documents(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_duplicates.drop_near_duplicates(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target of words: documents repeated, cut or left out, in training order."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, and its position: the order that the mix has written it in."""
    return bpe.tokenise_in_order(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near duplicates", near_dedup), ("personal data", personal_data), ("mixing", mix), ("byte-level BPE", tokens)]

#: Learned rules and BPE are not SQL: tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
