"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / weight``, ``u`` a hash of
``(seed, id, source)`` and ``weight`` its quality weight; sorted by key within
its source and prefix-summed, the first documents fill the source's token
budget.  A source whose target exceeds its size first takes whole epochs; only
the rest is selected.  The document at the budget's end is cut there.

No source is ever sorted whole.  Keys are mapped to ``BUCKETS`` bands of the
unit interval; word counts per (source, band) find the band where the budget
ends.  A band of more than ``EDGE_ROWS`` rows is divided again between its own
smallest and largest key (equal keys of one id: by row hash) until it has fewer,
and only what is left is sorted.  What comes out is one small row per source:
epochs, the key of the last document and the words taken of it; each document
then knows its share without another shuffle of the texts.

Defined results: a NULL or blank text has size 0 and takes 0; a NULL source is
a source of its own, last in code-point order; rows equal in id, source and
text share the cut evenly; if all texts are empty every target is 0; an empty
table gives an empty result; a very long text counts with all its words; ``mix``
neither reads nor returns other columns, ``mixed_documents`` returns them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.functions.keys import hash_key
from seqlake.llm.common import WORD, landed
from seqlake.operators.ordered import dense_index, running_sum

#: Parameters of the mix: repeating source weights, share of all words, most epochs of a source.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 42
BUCKETS = 4096
EDGE_ROWS = 4096   # most different rows of a source that one task sorts


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """1 minus the markup characters per word, from 0.1 up."""
    text = F.coalesce(text, F.lit(""))
    bare = text
    for ch in "#*$%&|<>!":
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    marks = (F.length(text) - F.length(bare)).cast("double")
    return F.greatest(F.lit(0.1), F.lit(1.0) - marks / F.greatest(size, F.lit(1)).cast("double"))


def keyed(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight: Column | None = None) -> DataFrame:
    """``df`` with ``_size, _key, _bucket, _row``."""
    u = (F.conv(F.substring(hash_key(seed, F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                                     F.coalesce(F.col(source_col), F.lit(""))), 1, 13), 16, 10).cast("bigint")
         .cast("double") + 0.5) / F.lit(float(1 << 52))
    df = df.withColumn("_size", n_words(F.col(text_col)))
    w = weight if weight is not None else quality_weight(F.col(text_col), F.col("_size"))
    df = df.withColumn("_key", -F.log(u) / w)
    band = F.floor(F.lit(BUCKETS) * (F.lit(1.0) - F.exp(-F.col("_key"))))
    return df.withColumn("_bucket", F.least(band, F.lit(BUCKETS - 1)).cast("int")).withColumn(
        "_row", F.xxhash64(id_col, source_col, text_col))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Targets are ``min(cap, level * weight)`` with the one level at which they add
    up to the total: what shares above their cap give back goes to the others by weight.
    """
    sizes = sizes.withColumn("_last", F.col("source").isNull())
    ranked = dense_index(sizes, ["_last", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight.cast("bigint")).withColumn("_cap", F.col("source_size") * max_epochs)
    ranked = landed(ranked.withColumn("_ratio", F.col("_cap") / F.col("_w")), "sources")
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    if not all_w:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    run = running_sum(ranked, {"_cc": "_cap", "_cw": "_w"}, ["_ratio", "_rank"])
    level = ((F.lit(float(total) * total_share) - (F.col("_cc") - F.col("_cap")).cast("double"))
             / (F.lit(all_w) - (F.col("_cw") - F.col("_w"))).cast("double"))
    found = run.withColumn("_level", level).where("_ratio >= _level").agg(
        F.min_by("_level", F.struct("_ratio", "_rank"))).first()[0]
    target = F.col("_cap").cast("double")
    if found is not None:   # else every source is at its cap
        target = F.least(target, F.lit(found) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _band_totals() -> list[Column]:
    """Words, rows, and the bounds of keys, ids and row hashes of a band."""
    key, row = F.col("_order._key"), F.col("_order._row").cast("double")
    return [F.sum("_size").alias("_s"), F.count("*").alias("_n"), F.min(key).alias("_lo"), F.max(key).alias("_hi"),
            F.min(row).alias("_rlo"), F.max(row).alias("_rhi"),
            (F.min("_order.id").eqNullSafe(F.max("_order.id")) & F.count("_order.id").isin(0, F.count("*"))).alias("_one_id")]


def _edge(bands: DataFrame) -> DataFrame:
    """The band of each source in which its ``_left`` words end, ``_left`` then counted from the band's start."""
    w = Window.partitionBy("_src").orderBy("_bucket")   # at most ``BUCKETS`` rows a source
    before = F.sum("_s").over(w) - F.col("_s")
    return landed(bands.withColumn("_before", before)
                  .where((F.col("_before") <= F.col("_left")) & (F.col("_before") + F.col("_s") > F.col("_left")))
                  .withColumn("_left", F.col("_left") - F.col("_before")).select(
                      "_src", "_bucket", "_left", "_n", "_lo", "_hi", "_rlo", "_rhi", "_one_id"), "edge")


def _inside(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """The rows (source in ``_of``) of each source's edge band."""
    edge = edge.select("_src", F.col("_bucket").alias("_b"), "_left")
    return rows.join(edge, F.col("_of").eqNullSafe(F.col("_src")) & (F.col("_bucket") == F.col("_b"))).select(
        "_src", "_left", "_size", "_order")


def _crowded() -> Column:
    return (F.col("_n") > EDGE_ROWS) & ((F.col("_lo") < F.col("_hi")) | (F.col("_one_id") & (F.col("_rlo") < F.col("_rhi"))))


def _place() -> Column:
    """Sub-band of a row between its band's bounds: never falls as the order rises."""
    by_key = (F.col("_order._key") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    by_row = (F.col("_order._row").cast("double") - F.col("_rlo")) / (F.col("_rhi") - F.col("_rlo"))
    part = F.when(F.col("_lo") < F.col("_hi"), by_key).otherwise(by_row)
    return F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           seed: int = SEED, weight: Column | None = None, **mix_parameters) -> DataFrame:
    """One row per source: ``source, source_size, target, epochs, cut`` (order of the cut document), ``cut_words``."""
    narrow = keyed(df.select(*dict.fromkeys([id_col, text_col, source_col])), id_col, text_col, source_col, seed, weight)
    order = F.struct("_key", F.col(id_col).alias("id"), "_row")
    narrow = landed(narrow.select(F.col(source_col).alias("source"), "_bucket", "_size", order.alias("_order")), "sizes")
    bands = landed(narrow.groupBy("source", "_bucket").agg(*_band_totals()), "bands")
    per = targets(bands.groupBy("source").agg(F.sum("_s").alias("source_size")), **mix_parameters)
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("bigint")
    per = per.withColumn("epochs", whole).withColumn(
        "_rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
    per = landed(per, "targets")

    edge = (bands.withColumnRenamed("source", "_src").join(per, F.col("_src").eqNullSafe(F.col("source")))
            .where("_rest > 0").withColumnRenamed("_rest", "_left"))
    edge = _edge(edge)
    rows, crowded, parts = _inside(narrow.withColumnRenamed("source", "_of"), edge), edge.where(_crowded()), []
    while not crowded.isEmpty():
        spans = crowded.select(F.col("_src").alias("_of"), "_lo", "_hi", "_rlo", "_rhi")
        met = landed(rows.join(spans, F.col("_src").eqNullSafe(F.col("_of")), "left").drop("_of")
                     .withColumn("_in", F.col("_lo").isNotNull()), "crowded")
        parts.append(met.where("NOT _in").select("_src", "_left", "_size", "_order"))
        met = met.where("_in").withColumn("_bucket", _place())
        edge = _edge(met.groupBy("_src", "_left", "_bucket").agg(*_band_totals()))
        rows = _inside(met.drop("_left").withColumnRenamed("_src", "_of"), edge)
        crowded = edge.where(_crowded())
    for part in parts:
        rows = rows.unionByName(part)
    inside = rows.groupBy("_src", "_left", "_order").agg(F.sum("_size").alias("_s"), F.count("*").alias("_n"))
    w = Window.partitionBy("_src").orderBy("_order")
    inside = (inside.withColumn("_end", F.sum("_s").over(w))
              .where((F.col("_end") > F.col("_left")) & (F.col("_end") - F.col("_s") <= F.col("_left")))
              .select("_src", F.col("_order").alias("cut"),
                      F.floor((F.col("_left") - (F.col("_end") - F.col("_s"))) / F.col("_n")).cast("bigint").alias("cut_words")))
    return landed(per.join(inside, F.col("source").eqNullSafe(F.col("_src")), "left")
                  .select("source", "source_size", "target", "epochs", "cut", "cut_words"), "shares")


def _with_shares(df: DataFrame, id_col, text_col, source_col, seed, weight, mix_parameters) -> DataFrame:
    per = shares(df, id_col, text_col, source_col, seed, weight, **mix_parameters)
    per = per.select(*[F.col(c).alias(f"_p_{c}") for c in per.columns])
    d = keyed(df, id_col, text_col, source_col, seed, weight)
    order = F.struct("_key", F.col(id_col).alias("id"), "_row")
    # one row per source: Spark broadcasts it where its written size allows, else it splits hot sources
    d = d.withColumn("_order", order).join(per, F.col(source_col).eqNullSafe(F.col("_p_source")))
    part = (F.when(F.col("_order") < F.col("_p_cut"), F.col("_size"))
            .when(F.col("_order") == F.col("_p_cut"), F.col("_p_cut_words")).otherwise(F.lit(0)).cast("bigint"))
    return d.withColumn("_part", part)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = SEED, weight: Column | None = None, **mix_parameters) -> DataFrame:
    """``id, size, source_size, target, taken``: one row per input row."""
    d = _with_shares(df.select(*dict.fromkeys([id_col, text_col, source_col])), id_col, text_col, source_col, seed,
                     weight, mix_parameters)
    return d.select(id_col, F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"),
                    F.col("_p_target").alias("target"),
                    (F.col("_p_epochs") * F.col("_size") + F.col("_part")).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    chars_col: str = "n_chars", seed: int = SEED, weight: Column | None = None,
                    **mix_parameters) -> DataFrame:
    """The mix itself: each document once per epoch and, if selected, once more (cut at the budget's end)."""
    d = _with_shares(df, id_col, text_col, source_col, seed, weight, mix_parameters)
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    full = F.col("_p_epochs") + F.when((F.col("_part") > 0) & ~cut, 1).otherwise(0)
    d = d.withColumn("_cut", F.explode(F.concat(
        F.array_repeat(F.lit(False), full.cast("int")),
        F.when(cut, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    upto = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    text = F.when(F.col("_cut"), F.array_join(F.slice(upto, F.lit(1), F.col("_part").cast("int")), "")).otherwise(
        F.col(text_col))
    d = d.withColumn(text_col, text)
    if chars_col in df.columns:
        d = d.withColumn(chars_col, F.when(F.col("_cut"), F.length(text_col)).otherwise(F.col(chars_col))
                         .cast(df.schema[chars_col].dataType))
    return d.select(*df.columns)
