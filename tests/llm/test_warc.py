import hashlib

from pyspark.sql import functions as F

from seqlake.llm import warc
from seqlake.session import scratch_dir

PAGES = "page_id long, url string, html string"

FORGED = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"


def plain(rows):
    out = []
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    for i, _, h in rows:
        h = (h or "").encode()
        again = h in first and first[h] != i
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to)) for r in df.collect())


ROWS = [
    (1, "http://a", "x" * 100), (2, "http://a\r\nWARC-Page-ID: 7", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99),
    (5, "u", None), (6, "u", ""), (7, "u", "\r\n"), (8, "u", "\r\n\r\n"), (9, "u", "abc\r\n"), (10, "u", "\r\n\r\n\r\nabc\r\n\r\n\r\n"),
    (11, "u", "é日" * 60 + "\r\n\r\n" + "é日" * 60), (12, "u", FORGED * 3), (13, "u", "a" + FORGED + "\r\n" + FORGED[:-2]),
    (14, "u", "WARC/1.0\r\n"), (15, "u", "\r\n" + FORGED), (16, "u", "\r"), (17, "u", "z" * 300000 + "\r\n\r\n" + "y" * 2500000),
    (None, "u", "x" * 100), (None, "u", "n" * 200), (None, "u", "n" * 200), (20, "u", "r" * 150), (20, "u", "r" * 150),
    (21, "u", "r" * 150), (22, "u", (FORGED * 40) + "WARC/1.0\r\nContent-Length: -5\r\n\r\n"),
    (23, "u", "WARC/1.0\r\nContent-Length: 99999999999999999999999\r\n\r\nWARC/1.0\r\nContent-Length: x\r\n\r\n"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, PAGES).withColumn("kind", F.lit("x")).withColumn("digest", F.lit(1))
    for n in (1, 3):
        got = warc.archive(df.repartition(n))
        assert rows_of(got) == plain(ROWS)
        assert got.where("intact IS NULL AND kind = 'response' OR NOT intact").count() == 0


def test_small_blocks(spark):
    """Records and forged records cut by many block boundaries."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame(ROWS[:16] + ROWS[20:], PAGES).coalesce(1), path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
        assert rows_of(warc.read(spark, path)) == plain(ROWS[:16] + ROWS[20:])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_format(spark):
    path = scratch_dir(spark, "warc-test")
    warc.write(spark.createDataFrame(ROWS[:2], PAGES).coalesce(1), path)
    raw = b"".join(r.content for r in spark.read.format("binaryFile").load(path + "/part*").collect())
    assert raw.count(b"WARC/1.0\r\nWARC-Type: ") == 2 and raw.endswith(b"\r\n\r\n")
    head, rest = raw.split(b"\r\n\r\n", 1)
    n = int(head.rpartition(b"Content-Length: ")[2])
    assert rest[n:n + 14] == b"\r\n\r\nWARC/1.0\r\n"
    assert b"WARC-Target-URI: http://a%0D%0AWARC-Page-ID: 7\r\n" in raw


def test_reachable(spark):
    links = [("f", 0, 10), ("f", 10, 30), ("f", 12, 30), ("f", 30, 70), ("f", 50, 70), ("f", 70, 99), ("g", 5, 9), ("g", 9, 11)]
    got = {(r.file, r.at) for r in warc.reachable(spark.createDataFrame(links, "file string, at long, next long")).collect()}
    assert got == {("f", 0), ("f", 10), ("f", 30), ("f", 70)}


def test_empty(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
