"""Join helpers: broadcast only behind a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of data above which a lookup side is left to Spark's own choice of join.
BROADCAST_BYTES = 64 << 20


def data_bytes(df: DataFrame) -> int:
    """Bytes of a table's values: text by its octets, other values as eight."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8)
             for f in df.schema.fields]
    return df.agg(F.coalesce(F.sum(sum(sizes, F.lit(0)).cast("bigint")), F.lit(0))).first()[0]


#: Heavy hitters a sketch follows; with the longest value taken as hot, also the bound of what is broadcast (9 MB).
HOT_ITEMS, HOT_BYTES = 1 << 16, 128
#: One occurrence in so many feeds the sketch (which values are hot decides their way through a join, never its result).
HOT_EVERY = 16
#: Sketches that are merged at the end, each united from those of many tasks.
HOT_GROUPS = 64


def hot_values(values: DataFrame, value: str, place) -> DataFrame:
    """``(value)``: the frequent values of a column, at most ``HOT_ITEMS``, none NULL or longer than ``HOT_BYTES``.

    Mergeable frequent-items sketches over a hash sample of the occurrences (``place``: columns that tell occurrences
    apart) of every row.  A value left out has at most a share of about ``4 / HOT_ITEMS`` of all occurrences, give or
    take the sample, so no task of a join on the rest gets a hot key.  The result is checkpointed: at most ``HOT_ITEMS``
    rows."""
    short = F.col(value).isNotNull()
    if values.schema[value].dataType.typeName() in ("string", "binary"):
        short &= F.octet_length(value) <= HOT_BYTES
    picked = values.where(short & (F.pmod(F.xxhash64(*place), F.lit(HOT_EVERY)) == 0)).select(F.col(value).alias("v"))
    partial = picked.groupBy((F.spark_partition_id() % HOT_GROUPS).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(v, {HOT_ITEMS})").alias("s"))
    found = partial.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {HOT_ITEMS}), {HOT_ITEMS})").alias("e"))
    return found.select(F.explode("e.item").alias(value)).checkpoint()


def sized_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its bytes are measured to be few, else ``df`` unchanged:
    Spark then plans a shuffle join (with skew splitting) by its own statistics."""
    return F.broadcast(df) if data_bytes(df) <= limit_bytes else df
