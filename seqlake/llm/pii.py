"""Personal data: patterns propose, checksums confirm, context words adjust.

Per text three steps: (1) regular expressions propose spans of each kind,
leftmost and non-overlapping within the kind; (2) validators confirm them
(octets, Luhn, digit counts, IBAN mod-97); (3) words near a span move its score.
The base kinds (email, ip, card, phone) stay whatever their score; the added
kinds (iban, phone_local, ssn) stay from ``KEEP_SCORE`` up.  Offsets are code
points, end exclusive.  Every scan is linear in the text, also for texts that
are one long run of digits or letters.

Defined results: a NULL or empty text has no spans; repeated rows each get a
row; an empty table gives an empty result; columns other than the id and the
text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqlake.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "phone_local", "ssn")
#: Prior score by kind, and words that raise or lower it nearby.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "phone_local": 0.5, "ssn": 0.3}
RAISE = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("call", "phone", "tel", "mobile"),
    "iban": ("iban", "bank", "account"), "phone_local": ("call", "phone", "tel", "fax"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
LOWER = ("example", "version", "isbn", "order", "sample")
CONTEXT_CHARS = 40
KEEP_SCORE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# every ip, card and phone lies inside one run of these characters
_RUN = re.compile(r"[+(0-9][0-9\x20().-]{6,}+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_LOCAL = re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country (IBAN registry).
IBAN_CHARS = {c: int(n) for n, codes in (pair.split(":") for pair in (
    "15:NO|16:BE|18:DK FI FK FO GL NL SD|19:MK SI|20:AT BA EE KZ LT LU MN XK|21:CH HR LI LV|"
    "22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ OM SO TL|24:AD CZ ES MD PK RO SA SE SK TN VG|25:LY PT ST|"
    "26:IS TR|27:BI DJ FR GR IT MC MR SM|28:AL AZ BY CY DO GT HN HU LB NI PL SV|29:BR EG PS QA UA|30:JO KW MU YE|"
    "31:MT SC|32:LC|33:RU").split("|")) for c in codes.split()}
_NEAR = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str):
    """An IBAN ends where its country says, of an unlisted country at the last word end that mod 97 confirms.

    The search goes on behind a confirmed IBAN, else at the next word: a proposal that
    runs on over the words around an IBAN hides none.  Each proposal is bounded.
    """
    m = _IBAN.search(text)
    while m:
        run, at = m[0], m.start() + 4
        for end in [len(run), *(k for k in range(len(run) - 1, 14, -1) if run[k] == " ")]:
            chars = end - run.count(" ", 0, end)
            if chars == IBAN_CHARS.get(run[:2], chars) and mod97(run[:end]):
                at = m.start() + end
                yield m.start(), at
                break
        m = _IBAN.search(text, at)


def _emails(text: str):
    """Each match holds one @; its local part is the run before it, cut at the previous match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        else:
            last = at + 1   # no match can start at or before this @
        at = text.find("@", at + 1)


def _numbers(text: str):
    for run in _RUN.finditer(text):
        s, off = run[0], run.start()
        if s.count(".") >= 3:
            for m in _IP.finditer(s):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    yield "ip", off + m.start(), off + m.end()
        if len(s) >= 16:
            for m in _CARD.finditer(s):
                if m.end() - m.start() >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        yield "card", off + m.start(), off + m.end()
        if s[0] == "+":
            m = _PHONE.match(s)
            if m and 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", off, off + m.end()
        if "-" in s:
            for m in _PHONE_LOCAL.finditer(s):
                yield "phone_local", off + m.start(), off + m.end()
            for m in _SSN.finditer(s):
                yield "ssn", off + m.start(), off + m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    words = set(_NEAR.findall(near.lower()))
    up = any(w in words for w in RAISE[kind])
    down = any(w in words for w in LOWER)
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.3 * up - 0.2 * down)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind as listed, then start."""
    if not text:
        return []
    found = {k: [] for k in BASE + ADDED}
    found["email"] = list(_emails(text))
    for kind, a, b in _numbers(text):
        found[kind].append((a, b))
    found["iban"] = list(_ibans(text))
    out = [(k, a, b, score(text, k, a, b)) for k in BASE for a, b in found[k]]
    return out + [(k, a, b, s) for k in ADDED for a, b in found[k] if (s := score(text, k, a, b)) >= KEEP_SCORE]


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_<kind>…, base_sha256, spans, findings``: one row per input row."""
    small_batches(df.sparkSession)
    kinds = BASE + ADDED
    finding = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                            T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)]
                          + [T.StructField(f"n_{k}", T.LongType()) for k in kinds]
                          + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
                             T.StructField("findings", T.ArrayType(finding))])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def scan(batches):
        for batch in batches:
            rows = [find_spans(t) for t in batch.column(1).to_pylist()]
            cols = [batch.column(0)]
            for k in kinds:
                cols.append([sum(1 for s in r if s[0] == k) for r in rows])
            joined = lambda r: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in r)
            cols.append([hashlib.sha256(joined([s for s in r if s[0] in BASE]).encode()).hexdigest() for r in rows])
            cols.append([joined(r) for r in rows])
            cols.append([[dict(zip(("kind", "start", "end", "score"), s)) for s in r] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [cols[0], *[pa.array(c, t) for c, t in zip(cols[1:], types[1:])]], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(scan, schema)
