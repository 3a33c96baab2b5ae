"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.session import ensure_checkpoint_dir, landed, small_batches  # noqa: F401  the last two: for this subpackage's modules

#: Fixed value: a word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that ``WORD`` treats as white space.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of a key filter: 512 rows of 4 KB, 2 MB in all, whatever the input.
FILTER_BITS = 1 << 24
_MAP_BITS = 4096 * 8


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by whatever path Spark can open."""
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns whose values are computed once and then only referred to.

    A one-row generator stops the optimizer from copying the expressions into
    the lambdas that use them, where they would run once per element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def bit_filter(keys: DataFrame, col: str):
    """``DataFrame -> DataFrame`` keeping the rows whose ``col`` may be among ``keys`` (never loses one)."""
    slot = F.pmod(F.col(col), F.lit(FILTER_BITS))
    maps = keys.groupBy(F.floor(slot / _MAP_BITS).alias("_fb")).agg(
        F.bitmap_construct_agg(slot % _MAP_BITS).alias("_fm"))
    maps = F.broadcast(landed(maps, "filter", compact=True))   # at most FILTER_BITS / 8 bytes

    def keep(df: DataFrame) -> DataFrame:
        at = (slot % _MAP_BITS).cast("int")
        byte = F.conv(F.hex(F.substring("_fm", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        # pmod of a power of two: the byte's bit by its place
        bit = F.getbit(byte, at % 8)
        return df.join(maps, F.floor(slot / _MAP_BITS) == F.col("_fb")).where(bit == 1).drop("_fb", "_fm")
    return keep
