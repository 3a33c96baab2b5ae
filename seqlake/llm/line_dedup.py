"""Line dedup by a deletion-neighbourhood join (columns only, no Python).

A line of a document is dropped if an earlier line anywhere in the corpus is
equal to it or one edit away (insert, delete or replace one code point).
Earlier means: smaller document id (NULL last), then smaller hash of the
document, then smaller line number.  Lines are compared without outer white
space; blank lines always stay.  ``min_equal`` is the shortest line, in code
points, that is compared for equality, ``min_near`` the shortest for one edit; a
line under ``min_equal`` always stays.  Both are ``MIN_CHARS`` unless given, as
the query's SQL has it; ``min_equal=1`` drops every repeated line.

Equal lines meet by hash.  For the rest the deletion neighbourhood is emitted:
two lines one edit apart share a variant, either the shorter one itself or both
without the character at one position.  To emit it only where it can match:

1. a line's first and last halves are hashed (one edit leaves one half whole);
   halves that only one distinct line has end there;
2. the other half is cut into ``WINDOWS``; the edit lies in one of them, so all
   around that window must be equal too; a window longer than ``NARROW`` is cut
   again in the same way until none is, so the work is linear in a line's length;
3. inside such a window all deletion variants are emitted as hashed keys and equal
   ones are joined; the whole lines, each without its deleted character, are
   compared.

Each step is lossless.  A variant's members are told apart by the deleted
position, so a member needs to meet only the earliest one of its position and
the undeleted line: no group is expanded into pairs.

Defined results: a NULL text has no lines and stays NULL; rows equal in id and
text are one document and share its result; a document whose lines all go is
dropped by ``dedup_lines`` and marked ``kept = false`` by ``deduped``; an empty
table gives an empty result.  Clashing column names are safe: the narrow work
runs on own columns, the result has the input's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqlake.llm.common import BLANKS, bit_filter, landed, staged

MIN_CHARS = 20
WINDOWS = 8
NARROW = 64   # longest window, in code points, whose deletion variants are emitted


def _lines(df: DataFrame, id_col: str, text_col: str, min_equal: int) -> DataFrame:
    """One row per line long enough to be compared: ``id, d1, d2, pos, x, n, h1, h2``."""
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    d = d.select("id", F.xxhash64("id", "t").alias("d1"), F.xxhash64(F.lit(1), "t", "id").alias("d2"),
                 F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    d = d.select("id", "d1", "d2", "pos", F.btrim("line", F.lit(BLANKS)).alias("x")).withColumn("n", F.length("x"))
    return d.where(F.col("n") >= min_equal).select(
        "*", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2"))


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("o"), F.col("id"), F.col("d1"), F.col("pos"))


def _halves() -> Column:
    """Array of ``(key, m, left)``: equal first or last halves, for each base length the line can share.

    The base is the shorter length rounded down to even, so lines of ``m`` to ``m + 2`` share it.
    """
    def of(m: Column) -> list[Column]:
        half = (m / 2).cast("int")
        return [F.struct(F.xxhash64(m, F.left("x", half)).alias("key"), m.alias("m"), F.lit(True).alias("left")),
                F.struct(F.xxhash64(-m, F.right("x", half)).alias("key"), m.alias("m"), F.lit(False).alias("left"))]
    even = (F.col("n") - F.col("n") % 2).cast("int")
    own = F.array(*of(even))
    return F.when(F.col("n") % 2 == 1, own).otherwise(F.concat(own, F.array(*of(even - 2))))


def _shared(keys: DataFrame, key: str) -> DataFrame:
    """Keys that two different lines have."""
    return keys.groupBy(key).agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"),
                                 F.max("h2").alias("d")).where("a <> b OR c <> d").select(key)


def _narrowed(cut: DataFrame) -> DataFrame:
    """Windows ``(h1, h2, first, w, a, at, win)`` cut into ``WINDOWS`` each, those kept whose surroundings two lines share.

    ``w`` is the hash of all that lies around the window, ``a`` its base length (its
    own is up to two more), ``at`` the code points before it in the line.
    """
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1))))
    start = F.floor(F.col("j") * F.col("a") / WINDOWS).cast("int")
    end = F.floor((F.col("j") + 1) * F.col("a") / WINDOWS).cast("int")
    tail = F.col("a") - end
    cut = cut.select("h1", "h2", "first",
                     F.xxhash64("w", "j", F.left("win", start), F.right("win", tail)).alias("w"),
                     (end - start).alias("a"), (F.col("at") + start).alias("at"),
                     F.substring("win", start + 1, F.length("win") - tail - start).alias("win"))
    around = landed(_shared(cut.select("h1", "h2", "w"), "w"), "windows", compact=True)
    return cut.join(around, "w")


def _without(line: str, place: Column) -> Column:
    """The line without the character at ``place`` (from 1; 0: the whole line)."""
    return F.when(place == 0, F.col(line)).otherwise(
        F.concat(F.left(line, place - 1), F.substring(line, place + 1, F.length(line))))


def _near(lines: DataFrame, first: DataFrame) -> DataFrame:
    """``(h1, h2, near)``: the earliest line one edit away, for lines that have an earlier one."""
    halves = lines.select("h1", "h2", F.inline(_halves()))
    shared = landed(_shared(halves.select("h1", "h2", "key"), "key"), "halves", compact=True)
    rows = lines.select("h1", "h2", "x", "n", F.inline(_halves()))
    rows = bit_filter(shared, "key")(rows).join(shared, "key", "left_semi")
    rows = rows.dropDuplicates(["key", "h1", "h2"])
    rows = landed(rows.join(first, ["h1", "h2"]), "half_lines", compact=True)

    half = (F.col("m") / 2).cast("int")
    rest = F.when(F.col("left"), F.substring("x", half + 1, F.col("n"))).otherwise(
        F.left("x", F.col("n") - half))
    at = F.when(F.col("left"), half).otherwise(F.lit(0))
    cut = _narrowed(rows.select("h1", "h2", "first", F.col("key").alias("w"), half.alias("a"), at.alias("at"),
                                rest.alias("win")))
    longest = rows.agg(F.max(F.ceil(half / WINDOWS))).first()[0] or 0
    done = []
    while longest > NARROW:   # the lines of one window have one base length: all of them go on, or none
        done.append(cut.where(F.col("a") <= NARROW))
        cut = _narrowed(landed(cut.where(F.col("a") > NARROW), "long_windows", compact=True))
        longest = -(-longest // WINDOWS)
    for part in done:
        cut = cut.union(part)

    places = F.sequence(F.lit(0), F.length("win"))   # 0: the window itself, i: without its i-th character
    variant = F.when(F.col("i") == 0, F.col("win")).otherwise(
        F.concat(F.left("win", F.col("i") - 1), F.substring("win", F.col("i") + 1, F.length("win"))))
    place = F.when(F.col("i") == 0, 0).otherwise(F.col("at") + F.col("i"))   # in the whole line
    emitted = cut.select("h1", "h2", "first", "w", "win", "at", F.explode(places).alias("i")).select(
        F.xxhash64("w", variant).alias("v"), "i", F.struct("first", "h1", "h2", place.alias("at")).alias("me"))
    # a variant's members are one line and that line with one character more: few, however hot the corpus
    by_v, by_place = Window.partitionBy("v"), Window.partitionBy("v", "i")
    met = emitted.select(
        "me", F.min("me").over(by_place).alias("same"),
        F.min(F.when(F.col("i") == 0, F.col("me"))).over(by_v).alias("line"),
        F.min(F.when(F.col("i") > 0, F.col("me"))).over(by_v).alias("longer"), "i")
    met = met.select("me", F.explode(F.when(F.col("i") > 0, F.array("same", "line")).otherwise(
        F.array("longer"))).alias("other"))
    # lines that meet at several places (inside a run of one character) are compared at one of them
    pairs = met.where(F.col("other.first") < F.col("me.first")).groupBy(
        F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.col("other.h1").alias("g1"),
        F.col("other.h2").alias("g2")).agg(F.min("other.first").alias("near"),
                                           F.min(F.struct("me.at", F.col("other.at").alias("to"))).alias("places"))
    texts = rows.select("h1", "h2", "x").dropDuplicates(["h1", "h2"])
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("x").alias("y"))
    proven = pairs.join(texts, ["h1", "h2"]).join(other, ["g1", "g2"]).where(
        _without("x", F.col("places.at")) == _without("y", F.col("places.to")))
    return proven.groupBy("h1", "h2").agg(F.min("near").alias("near"))


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_equal: int = MIN_CHARS, min_near: int = MIN_CHARS) -> DataFrame:
    """``(d1, d2, gone)``: the line numbers that go, for each document (by its two hashes) that loses any."""
    if not 1 <= min_equal <= min_near:
        raise ValueError("1 <= min_equal <= min_near is needed")
    lines = _lines(df, id_col, text_col, min_equal)
    seen = landed(lines.select("id", "d1", "d2", "pos", "h1", "h2"), "lines")
    first = landed(seen.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("times")), "first")
    long = lines if min_near == min_equal else lines.where(F.col("n") >= min_near)
    near = _near(long.select("h1", "h2", "x", "n"), first.drop("times"))
    best = first.join(near, ["h1", "h2"], "left").where("times > 1 OR near IS NOT NULL").select(
        "h1", "h2", F.least("first", "near").alias("best"))
    best = landed(best, "best", compact=True)
    gone = seen.join(best, ["h1", "h2"]).where(F.col("best") < _order())
    return gone.groupBy("d1", "d2").agg(F.collect_set("pos").alias("gone"))


def deduped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            min_equal: int = MIN_CHARS, min_near: int = MIN_CHARS) -> DataFrame:
    """``id, n_dropped, kept, text``: one row per document, its text without the dropped lines."""
    d = _without_gone(df, id_col, text_col, min_equal, min_near)
    return d.select(id_col, F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
                    _alive().alias("kept"), F.col("_text").alias("text"))


def _without_gone(df: DataFrame, id_col: str, text_col: str, min_equal: int, min_near: int) -> DataFrame:
    """``df`` with ``_gone`` (line numbers, NULL if none go) and ``_text``."""
    gone = landed(dropped_lines(df, id_col, text_col, min_equal, min_near), "gone")
    gone = gone.select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.col("gone").alias("_gone"))
    d = df.withColumn("_d1", F.xxhash64(id_col, text_col)).withColumn("_d2", F.xxhash64(F.lit(1), text_col, id_col))
    d = d.join(gone, ["_d1", "_d2"], "left")
    d = staged(d, _lines=F.when(F.col("_gone").isNotNull(), F.split(F.col(text_col), "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")   # by hash set: linear
    text = F.array_join(F.transform(stay, lambda p: F.get("_lines", p)), "\n")
    return d.withColumn("_text", F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(text))


def _alive() -> Column:
    return F.col("_gone").isNull() | (F.length(F.btrim("_text", F.lit(BLANKS))) > 0)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                chars_col: str = "n_chars", min_equal: int = MIN_CHARS, min_near: int = MIN_CHARS) -> DataFrame:
    """``df`` with the dropped lines cut out of its texts; documents that lose every line go."""
    d = _without_gone(df, id_col, text_col, min_equal, min_near).where(_alive())
    d = d.withColumn(text_col, F.col("_text"))
    if chars_col in df.columns:
        d = d.withColumn(chars_col, F.when(F.col("_gone").isNull(), F.col(chars_col)).otherwise(F.length(text_col))
                         .cast(df.schema[chars_col].dataType))
    return d.select(*df.columns)
