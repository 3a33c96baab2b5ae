"""Driver tables mapped onto the reference's relations, with the
matching SQL fragments for the DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.functions.text import WS_PATTERN, split_ws
from seqlake.plans.registry import table

SEED = 42
CHUNK_LEN = 257


def sql_tokens(col: str) -> str:
    """DuckDB twin of ``split_ws``."""
    return f"list_filter(regexp_split_to_array({col}, '{WS_PATTERN}'), lambda x: x <> '')"


def sql_text(arr: str) -> str:
    return f"array_to_string({arr}, ' ')"


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Move sequences: ``documents.text`` split on whitespace; shard = source."""
    return (table(spark, sf_dir, "documents")
            .select("doc_id", F.col("source").alias("shard"), "lang",
                    split_ws("text").alias("tokens")))


SQL_DOC_TOKENS = f"""
  SELECT doc_id, source AS shard, lang, {sql_tokens('text')} AS tokens FROM documents
"""
