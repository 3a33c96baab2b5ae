"""Text-line and newline-delimited JSON sources/sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.functions.text import join_ws

CORRUPT = "_corrupt_line"


def write_lines(df: DataFrame, path: str, tokens_col: str = "tokens", stem_col: str = "stem",
                mode: str = "overwrite") -> None:
    """One sequence per line, tokens joined by one space, one folder per
    source stem; a source with no surviving sequence writes nothing."""
    (df.where(F.size(tokens_col) > 0)
       .select(stem_col, join_ws(tokens_col).alias("value"))
       .hint("rebalance", stem_col)   # a stem's lines side by side: few files, large stems split
       .write.mode(mode).partitionBy(stem_col).text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file under ``path``; empty lines are ignored."""
    return spark.read.text(path).where(F.length("value") > 0)


def parse_ndjson(lines: DataFrame, schema: T.StructType | str, value_col: str = "value",
                 keep_bad: bool = False) -> DataFrame:
    """Newline-delimited JSON with blank lines skipped.  Each line is parsed
    with an explicit schema; a line that is not a JSON object gets
    ``reject_reason = 'bad_json'`` (A13) and is dropped unless ``keep_bad``."""
    nonblank = lines.where(F.length(F.trim(F.col(value_col))) > 0)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # a line that does not parse fills this extra field; its other fields are NULL as in a valid sparse object
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = nonblank.withColumn("_j", F.from_json(
        value_col, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_j").isNull() | F.col(f"_j.{CORRUPT}").isNotNull()
    out = parsed.select(*[F.col(f"_j.`{f}`").alias(f) for f in schema.fieldNames()],
                        F.when(bad, F.lit("bad_json")).alias("reject_reason"))
    return out if keep_bad else out.where(F.col("reject_reason").isNull()).drop("reject_reason")


def read_ndjson(spark: SparkSession, path: str, schema, keep_bad: bool = False) -> DataFrame:
    return parse_ndjson(spark.read.text(path), schema, keep_bad=keep_bad)
