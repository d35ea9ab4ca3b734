"""Corpus pipeline: quality, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its
result is written as Parquet and read back as the next stage's documents. All but
the last return the columns of ``documents``; the last returns packed pieces with
their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from tickloom.llm.common import Scratch
from tickloom.llm.queries import table, tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_owners(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("exact", drop_copies), ("near", drop_near_copies), ("mix", mix_sources), ("pack", pack_sequences)]

#: the classifier has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next reads it."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.store(docs, name)
    return docs
