"""The corpus pipeline: quality, exact dedup, near dedup, secrets, packing; each stage works on all that the one before kept.

Defined cases, the same in every stage: a null text counts as empty, and stays null where a stage hands it on; empty
texts are judged, are copies of each other, have no near copies, hold no secret and pack as their end token; rows with
a null doc_id are judged by their text and lose to rows with an id among copies; of rows that repeat id and text one
stays from ``exact`` on; ties go to the smallest doc_id; an empty table gives empty results; extra columns, whatever
their names, pass through all stages but the last, which has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracery.llm.common import written
from tracery.llm.exact_dedup import drop_copies
from tracery.llm.lp_packing import pack
from tracery.llm.minhash_dedup import drop_near_copies
from tracery.llm.quality_rules import drop_rejected
from tracery.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble does not reject; it learns from the labels beside ``docs``."""
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8)."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 1024."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("packing", packing)]

#: The stages train models and pack token sequences, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
