"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, source mixing, SentencePiece.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written as
Parquet in the shared folder and read again as the next stage's ``docs``.  All
but the last return the columns of ``documents``; the last returns the encoded
rows of the mix, one per document and epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import line_dedup, mixing, sentencepiece, simhash
from seqlake.llm import toxicity as tox
from seqlake.llm.common import landed, load
from seqlake.llm.queries import toxicity_chain


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic."""
    return tox.without(docs, toxicity_chain(spark, docs, sf_dir), "toxic")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats; documents with nothing else go."""
    return line_dedup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every row of the mix."""
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
