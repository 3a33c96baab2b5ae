import hashlib
import re

import pytest
from pyspark.sql import functions as F

from seqlake.llm import pii, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(c) for c in d[-1::-2])
        even = sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
        if 16 <= len(d) <= 19 and (odd + even) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


TEXTS = [
    None, "", " ", "mail a.b@c.de_x@y.zz and @ @@ x@y a@b.c.", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 1..2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559", "+49 (30) 1234-567. +1 2+3333333333 +1-2",
    "call (555) 123-4567 or ssn 123-45-6789, plain 123-45-6789", "é ü +33 1 23 45 67 89 日本 x@y.jp",
    "IBAN DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE89370400440532013001",
    "1" * 3000, "a" * 3000 + "@", "1.1" * 900, "(" * 500 + "+" * 500, "+1" * 800, "@" * 2000, "4" * 16 + "." + "+1 234 5678 ",
    "192.168.1.1@host.com +12.34.56.78", "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 2",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE] == brute(text)


def test_base_spans_random():
    import random
    rng = random.Random(7)
    for _ in range(3000):
        t = "".join(rng.choice("0123456789..+-() @ab") for _ in range(rng.randint(0, 60)))
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE] == brute(t), t


def test_checksums_and_context():
    found = {s[0]: s for s in pii.find_spans(TEXTS[7])}
    assert "phone_local" in found and "ssn" in found
    assert [s[0] for s in pii.find_spans("plain 123-45-6789")] == []
    assert [s[0] for s in pii.find_spans(TEXTS[9])] == ["iban", "iban"]


@pytest.mark.parametrize("text, want", [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
    ("GB82WEST12345698765432 TODAY", ["GB82WEST12345698765432"]),
    ("GB82WEST12345698765432 12 May", ["GB82WEST12345698765432"]),
    ("DE89370400440532013000 I wrote", ["DE89370400440532013000"]),
    ("AB12 CD34 DE89 3704 0044 0532 0130 00 NO93 8601 1117 947 X", ["DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]),
    ("ZZ22 3704 0044 0532 0130 00 BIC", ["ZZ22 3704 0044 0532 0130 00"]),   # no listed country
    ("DE89 3704 0044 0532 0130 01 BIC", []), ("DE89 3704 0044 0532 0130 00X", []), ("A" + "B12 " * 2000, []),
])
def test_iban_before_other_words(text, want):
    assert [text[a:b] for k, a, b, _ in pii.find_spans(text) if k == "iban"] == want


def test_detect_rows(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)] + [(None, "x@y.zz", "en", "s", 6)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("kind", F.lit("clash"))
    got = pii.detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "x@y.zz" if r.doc_id is None else TEXTS[r.doc_id]
        b = brute(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()
        assert r.n_email == sum(x[0] == "email" for x in b) and r.n_phone == sum(x[0] == "phone" for x in b)
    assert pii.detect(spark.createDataFrame([], DOCS)).count() == 0


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", "  \n\n", "a b c a b c a b c", "one two", "x y z\nx y z\n\x0b\nx y z ", "é é é é é é", "a\x85b c 　",
             "w " * 400, " ".join(f"w{i}" for i in range(400)), "#a %b\r\n#a %b\r\n" * 30, " " * 5000, "a a a b a a a"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "a b", None, None, None)] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = quality.quality(df).collect()
    assert len(got) == len(rows)
    for r in got:
        t = "a b" if r.doc_id is None else texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} == {9}
    assert quality.quality(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_order_follows_sample(spark):
    df = spark.createDataFrame([(i, "@ " * 60 + " ".join(f"w{j}" for j in range(60))) for i in range(50)], "doc_id long, text string")
    named = {"never": F.col("n_words") < 0, "always": F.col("n_words") > 0}
    assert quality.cascade_order(quality.base_counts(df), named) == ["always", "never"]
