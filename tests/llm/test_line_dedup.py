import random

from pyspark.sql import functions as F

from seqlake.llm import line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANKS = " \t\n\x0b\x0c\r"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    """Documents by id, lines in order; a line goes if any earlier one is within one edit."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            x = line.strip(BLANKS)
            gone = len(x) >= 20 and any(one_edit(x, y) for y in seen)
            if len(x) >= 20:
                seen.append(x)
            if not gone:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


def _corpus():
    rng = random.Random(2)
    bases = ["".join(rng.choice("ab é日") for _ in range(rng.choice([20, 21, 22, 40, 41, 97]))) + "z" for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "short\nshort\nshort")]
    for i in range(4, 90):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(x) + 1)
                x = rng.choice([x[:k] + rng.choice("abé") + x[k:], x[:k] + x[k + 1:], x[:k] + rng.choice("abq") + x[k + 1:]])
            lines.append(rng.choice(["", " ", "\t"]) + x + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines)))
    rows.append((200, "x" * 5000 + "\n" + "x" * 5001 + "\n" + "x" * 5003))
    return rows


def test_equals_brute_force(spark):
    rows = _corpus()
    want = brute(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in line_dedup.deduped(df.withColumn("first", F.lit(1)).withColumn("n", F.lit(2))).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].text == want[i], i
        lost = (t or "").count("\n") - (want[i] or "").count("\n")
        assert got[i].n_dropped == lost + (want[i] == "" and bool(t) and got[i].n_dropped == lost + 1)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    gone = {i for i, t in rows if t and want[i] != t and not want[i].strip(BLANKS)}
    assert kept == {i: want[i] for i, _ in rows if i not in gone}


def test_ties_nulls_and_repeats(spark):
    a, b = "the very same line of text", "the very same line of texts"
    rows = [(None, a), (5, a + "\n" + b), (5, a + "\n" + b), (9, b), (None, "x" * 30)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = sorted((str(r.doc_id), r.text, r.kept) for r in line_dedup.deduped(df).collect())
    assert got == sorted([("None", "", False), ("5", a, True), ("5", a, True), ("9", "", False), ("None", "x" * 30, True)])
    empty = spark.createDataFrame([], DOCS)
    assert line_dedup.deduped(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


def test_one_common_line(spark):
    """A line that a third of all rows hold, and a group of lines that differ in one character."""
    common = "a line that very many documents share"
    rows = [(i, common if i % 3 else f"page number {chr(0x4e00 + i)} of the long report") for i in range(300)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()
    assert sorted(r.doc_id for r in got) == [0, 1]


def test_short_equal_lines_and_lower_bounds(spark):
    """With the bounds given, short lines take part: repeats go, near lines from ``min_near`` up."""
    rng = random.Random(5)
    short = ["Home", "menu", "menus", "- item", "* * *", "日本", "a", "b", "ab", "a line of just 19 c", "a line of just 20 ch"]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(short) for _ in range(rng.randint(1, 5)))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    for min_equal, min_near in ((1, 20), (3, 5), (1, 1)):
        seen, want = [], {}
        for i, t in rows:
            kept = []
            for line in t.split("\n"):
                x = line.strip(BLANKS)
                if not (len(x) >= min_equal and any(x == y or min(len(x), len(y)) >= min_near and one_edit(x, y) for y in seen)):
                    kept.append(line)
                if len(x) >= min_equal:
                    seen.append(x)
            want[i] = "\n".join(kept)
        got = line_dedup.deduped(df, min_equal=min_equal, min_near=min_near).collect()
        assert {r.doc_id: r.text for r in got} == want
        out = line_dedup.dedup_lines(df, min_equal=min_equal, min_near=min_near)
        assert {r.doc_id for r in out.collect()} == {i for i, t in want.items() if t.strip(BLANKS) or t == rows[i][1]}


def test_very_long_lines(spark):
    """Lines of many windows: one edit anywhere is found, two edits are not, whatever the place or a run around it."""
    rng = random.Random(11)
    base = "".join(rng.choice("abcdefgh é日") for _ in range(40_000)) + "."
    rows, want = [(0, base)], {0}
    for n, k in enumerate([0, 1, 2499, 2500, 19_999, 20_000, 20_001, 31_234, 39_999, 40_000]):
        near = (base[:k] + "#" + base[k + 1:], base[:k] + base[k + 1:], base[:k] + "#" + base[k:])[n % 3]
        rows.append((10 + n, near))
        far = base[:k] + "##" + base[k + 1:]
        rows.append((100 + n, "%d %s" % (n, far[::-1])))
        want.add(100 + n)
    run = "=" * 30_000
    rows += [(200, run), (201, run + "="), (202, run + "==="), (203, run[:9_000] + "-" + run[9_001:])]
    want |= {200, 202}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    assert {r.doc_id for r in line_dedup.dedup_lines(df).select("doc_id").collect()} == want
