"""A training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes all that its predecessor kept.  The first three drop documents (toxic
ones, all but one of each near-duplicate group, those with benchmark passages), the fourth
replaces secrets in the texts, the last gives the token ids of what is left.  All stages but
the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lintlake.llm import bpe, decontaminate, near_copies, secrets, toxicity
from lintlake.llm.common import read, written

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors hold other stages' heap too: smaller caches and blocks, and none left behind
    return bpe.encode(docs, VOCABULARY, digests=True, cache=75_000, block=1024 * 1024, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

ORACLE_SQL = None  # a classifier, fingerprints and a tokenizer: tested against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
