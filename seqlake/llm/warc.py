"""WARC archives: written by the text sink, read back by boundary-chain verification.

Writing: a record is one row of text whose separator is the blank line that ends
a WARC record, so Spark's own writer (and its commit protocol) makes the files.
Of equal payloads of ``MIN_REVISIT`` bytes or more, the smallest page id keeps
the payload; the others become revisit records that refer to it.

Reading: tasks split the files at blank lines.  Offsets follow from the lengths
alone.  Every piece that holds the record magic gives one candidate: its offset
and, by its Content-Length, the offset of its successor.  A payload may hold the
magic, even a whole forged record, so candidates prove nothing; only those that
a chain of successors reaches from the start of their file are records.  The
chain is followed by pointer jumping: in each round every pointer doubles its
stride and the reached set grows by one jump, so a file of n candidates needs
log2(n) rounds of joins, however its blocks are spread over tasks.

Payload digests are taken from the bytes read.  A payload that holds a blank
line itself is put together again from its pieces before it is digested.

Defined results: a NULL payload is empty; a NULL id is written without an id
and never referred to unless no other page has the payload; rows that share the
smallest id of a payload are all responses; a NULL url is left out, control
characters in urls are escaped; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqlake.llm.common import landed
from seqlake.session import scratch_dir

#: Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
BLANK_LINE = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are always stored.
MIN_REVISIT = 100
_BIN = 1 << 20


def decided(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
            min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``id, url, payload, digest, bytes, kind, refers_to``: what is to be written for each page."""
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                     F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    d = d.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    # only payloads that occur twice need a partner; written first, so that Spark knows their true size
    shared = (d.where(F.col("bytes") >= min_revisit).groupBy("digest")
              .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    d = d.join(landed(shared, "payloads", compact=True), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return d.select("id", "url", "payload", "digest", "bytes", F.when(again, "revisit").otherwise("response").alias("kind"),
                    F.when(again, F.col("first")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _record_id(digest: Column, page: Column) -> Column:
    h = F.md5(F.concat_ws(":", digest, page.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Write one record per page under ``path``."""
    d = decided(pages, **columns)
    stored = F.col("kind") == "response"
    body = F.when(stored, F.col("payload")).otherwise(F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.lit("Content-Length: "), F.col("bytes").cast("string"))
    block = F.concat(http, F.lit(BLANK_LINE), body)
    # header values cannot break lines: control characters are escaped
    url = F.col("url")
    for code in (*range(32), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.col("kind"), F.lit("\r\n"),
        _line("WARC-Record-ID", _record_id(F.col("digest"), F.col("id"))),
        _line("WARC-Target-URI", url), F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(stored, F.lit("")).otherwise(_line("WARC-Payload-Length", F.col("bytes"))),
        _line("WARC-Page-ID", F.col("id")),
        F.when(~stored, F.concat(_line("WARC-Refers-To", _record_id(F.col("digest"), F.col("refers_to"))),
                                 _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
                                 F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    d.select(F.concat(head, F.lit(BLANK_LINE), block).alias("value")).write.option("lineSep", BLANK_LINE).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, nth, value``: the files' pieces between blank lines, in order within a block.

    Files go by a hash of their path: paths would weigh more than all else in the chain's joins."""
    return spark.read.option("lineSep", BLANK_LINE).text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), "value")


def _located(pieces: DataFrame, *columns) -> DataFrame:
    """Pieces with their byte offset ``at`` in the file and length ``n``, by running sums in and over blocks."""
    d = pieces.select("file", "block", "nth", F.octet_length("value").cast("bigint").alias("n"), *columns)
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("file", "block").agg(F.sum(F.col("n") + len(BLANK_LINE)).alias("s"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    d = d.withColumn("at", F.coalesce(F.sum(F.col("n") + len(BLANK_LINE)).over(inside), F.lit(0)))
    return d.join(sums, ["file", "block"]).withColumn("at", F.col("at") + F.col("start")).drop("block", "nth", "start")


def reachable(links: DataFrame) -> DataFrame:
    """``(file, at)`` of the candidates that successor offsets ``(file, at, next)`` reach from offset 0."""
    jump = landed(links.select("file", "at", "next"), "jump", compact=True)
    reached = landed(jump.where("at = 0").select("file", "at"), "reached", compact=True)
    n = reached.count()
    while n:
        hop = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        # an end of file is no candidate: it drops out here
        grown = landed(reached.union(hop.join(links, ["file", "at"], "left_semi")).distinct(), "reached", compact=True)
        now = grown.count()
        if now == n:
            return grown
        reached, n = grown, now
        far = jump.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jump = landed(jump.join(far, ["file", "next"]).select("file", "at", F.col("far").alias("next")), "jump", compact=True)
    return reached


def _field(name: str, kind: str = "string") -> Column:
    found = F.regexp_extract("head", f"(?:^|\\n){name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found).cast(kind)


def read(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """One row per verified record: ``file`` (hash of the path), ``at, page_id, url, kind, refers_to, payload_bytes, payload_digest, intact``.

    ``intact`` tells whether the stored bytes have the digest their header names (NULL for
    revisits, which store none).
    """
    id_type = id_type or T.LongType()
    pieces = _pieces(spark, path)
    # the header of a record runs from the magic to the end of its piece, so the last magic is the only candidate
    head = F.when(F.contains("value", F.lit(MAGIC)), F.element_at(F.split("value", MAGIC.replace(".", r"\."), -1), -1))
    located = landed(_located(pieces.select("*", head.alias("head"), F.unhex(F.sha2("value", 256)).alias("sha")), "head", "sha"), "located")
    found = located.where("head IS NOT NULL").select(
        "file", (F.col("at") + F.col("n") - F.octet_length("head") - len(MAGIC)).alias("at"),
        (F.col("at") + F.col("n") + len(BLANK_LINE)).alias("body"), "head")
    found = found.withColumn("size", _field("Content-Length").try_cast("bigint")).where("size >= 0")
    found = landed(found.withColumn("next", F.col("body") + F.col("size") + len(BLANK_LINE)), "candidates", compact=True)
    records = found.join(reachable(found.select("file", "at", "next")), ["file", "at"])
    records = records.select(
        "file", "at", "body", "size", _field("WARC-Page-ID").cast(id_type).alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("kind"),
        _field("WARC-Refers-To-Page-ID").cast(id_type).alias("refers_to"),
        _field("WARC-Payload-Length", "bigint").alias("said_bytes"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("said_digest"))

    # the block's first piece is the HTTP header, its payload starts right behind
    starts = located.select("file", F.col("at").alias("body"), F.col("n").alias("http"))
    records = records.join(starts, ["file", "body"]).withColumn("start", F.col("body") + F.col("http") + len(BLANK_LINE))
    records = records.withColumn("payload_bytes", F.col("body") + F.col("size") - F.col("start"))
    first = located.select("file", F.col("at").alias("start"), F.col("n").alias("piece"), "sha")
    records = landed(records.join(first, ["file", "start"], "left"), "records", compact=True)
    whole = records.where("kind = 'revisit' OR piece = payload_bytes")
    split = records.where("NOT (kind = 'revisit' OR piece = payload_bytes) OR piece IS NULL").drop("sha")
    joined = _reassembled(pieces, split)
    out = whole.unionByName(split.join(joined, ["file", "at"], "left"))
    stored = F.col("kind") != "revisit"
    out = out.withColumn("sha", F.lower(F.hex("sha")))
    return out.select(
        "file", "at", "page_id", "url", "kind", "refers_to",
        F.when(stored, F.col("payload_bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("sha")).otherwise(F.col("said_digest")).alias("payload_digest"),
        F.when(stored, F.col("sha") == F.col("said_digest")).alias("intact"))


def _reassembled(pieces: DataFrame, split: DataFrame) -> DataFrame:
    """``file, at, sha`` of payloads that blank lines cut into several pieces (one payload's pieces at a time)."""
    wanted = split.select("file", "at", "start", (F.col("start") + F.col("payload_bytes")).alias("end"))
    wanted = landed(wanted, "wanted", compact=True)
    if wanted.isEmpty():
        return wanted.select("file", "at", F.lit(None).cast("binary").alias("sha"))
    wanted = wanted.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / _BIN), F.floor(F.col("end") / _BIN))))
    # only files that hold such payloads are read again
    again = pieces.join(wanted.select("file").distinct(), "file", "left_semi")
    parts = _located(again, "value").withColumn("bin", F.floor(F.col("at") / _BIN)).withColumnRenamed("at", "piece_at")
    mine = parts.join(wanted, ["file", "bin"]).where("piece_at >= start AND piece_at < end OR piece_at = start")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_at", "value"))), lambda p: p["value"]), BLANK_LINE)
    whole = F.concat(F.encode(text, "utf-8"), F.lit(BLANK_LINE.encode()))   # a payload may end in half a blank line
    return mine.groupBy("file", "at", "start", "end").agg(whole.alias("b")).select(
        "file", "at", F.unhex(F.sha2(F.substring("b", F.lit(1), (F.col("end") - F.col("start")).cast("int")), 256)).alias("sha"))


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back (columns of ``read``)."""
    path = scratch_dir(pages.sparkSession, "warc")
    write(pages, path, id_col=id_col, payload_col=payload_col, url_col=url_col)
    return read(pages.sparkSession, path, pages.schema[id_col].dataType)
