"""Corpus pipeline: toxicity, quality rules, near duplicates, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
the rows that it keeps with the columns of ``docs``, the last one the packed pieces. ``run``
applies them to the table ``documents``; each stage's rows are written to the shared folder
and read again by the next.

Nulls and odd rows: a null text counts as empty; quality rules reject it (fewer than ten
words). Rows without an id pass every stage that accepts their text and are packed with a
null id. Rows that repeat an id are one document to the near-duplicate stage and are each packed.
Ties (equal texts) leave the smallest id. Very long texts are read whole and cut into pieces.
Extra columns pass through to the packing stage, whatever their names. Empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from greenscan.llm import minhash, packing, quality, toxicity
from greenscan.llm.common import table, written
from greenscan.llm.tokenizing import vocabulary

VOCABULARY, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
CACHED_WORDS = 200_000  # workers of earlier stages are still alive beside the packer's


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; the model learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep, judged against the documents given."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return minhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packing.pack_documents(docs, vocabulary(VOCABULARY), END_ID, CAPACITY, cached_words=CACHED_WORDS)


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality),
          ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

# No SQL: scores of trained compressors, minimum hashing and tokenization; tests/llm compares
# the rows with the operators applied one after another and with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
