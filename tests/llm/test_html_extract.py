import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import html_extract as H

PAGES = "page_id long, url string, html string"


def texts_of(page):
    return [b[0] for b in H.Blocks().cut(page)]


def test_blocks():
    page = ("<!DOCTYPE html><title>no</title><style>p{}</style><script>var t=\"</p>\";</script><!-- <p>no</p> -->"
            "lead<p>a <b>b\n c<br>d<p>e&amp;&lt;f&nbsp;g</p>tail<ul><li>x<li>y</ul><td>z</div></span>")
    assert texts_of(page) == ["lead", "a b c d", "e&<f g", "tail", "x", "y", "z"]


@pytest.mark.parametrize("page", ["", "<", "a < b > c <", "<p", "<p class=\"x", "</p></p>", "<!--", "<![CDATA[x", "<script>x",
                                  "<a<b<c", "&#0;&#x110000;&bogus;", "<p>" * 3000 + "x", "<div>" * 3000 + "x", "<" * 5000, "\0"])
def test_broken_pages_do_not_fail(page):
    texts_of(page)


@pytest.mark.parametrize("page, want", [
    ("<p>a <svg class=icon/> b</p><p>c", ["a b", "c"]),
    ("<p>a <math/> b<svg /></p><p>c</p><svg><path d=x /></svg><p>d", ["a b", "c", "d"]),
    ("<p>a <svg><path d=x> b<p>c</p><div>d <math><mi>x</div>e", ["a b", "c", "d x", "e"]),
    ("<p>so <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> holds</p>", ["so x<2 holds"]),
    ("<svg><title>t</title><style>p > a {}</style><script/><text>drawn</text><desc>no</desc></svg> on<p>p", ["drawn on", "p"]),
    ("<svg><title>t<p>c</p><svg><title>u</svg>d", ["c", "d"]),
    ("<svg><foreignObject><div>in</div><p>two</p></foreignObject></svg>out", ["in", "two", "out"]),
    ("<p>a<select><option>x<option>y<p>c</p>d", ["a", "x", "y", "c", "d"]),
    ("<template><p>t</p></template><p>c</p><template>u<p>d", ["t", "c", "u", "d"]),
    ("a<script>x<p>y</p>", ["a"]), ("a<iframe/>x</iframe><p>c", ["a", "c"]), ("</svg></math>a</select>b", ["a", "b"]),
])
def test_no_text_is_lost_behind_embedded_elements(page, want):
    assert texts_of(page) == want


def test_tags_and_ancestors():
    cut = H.Blocks().cut('<nav class="topMenu"><p>m</p></nav><article><div class=ad>s</div><p>t <a href=x>link</a></article><p>u')
    assert [(c[0], c[1]) for c in cut] == [("m", "p"), ("s", "div"), ("t link", "p"), ("u", "p")]
    assert "role:menu" in cut[0][2] and "role:ad" in cut[1][2] and "in:article" in cut[2][2] and "in:article" not in cut[3][2]
    assert cut[2][3] == pytest.approx(4 / 6)


def test_capitals_count_over_the_whole_block():
    for text, want in (("A" * 150 + "b" * 1000, False), ("a" * 250 + "B" * 300, True), ("AB c", False), ("ABC d", True)):
        assert ("capitals" in H.text_features(text, "p", 0.0, 0.0)) == want


def test_sample_bound_is_a_parameter(spark, monkeypatch):
    """The longest page of the training sample: text of longer pages trains nothing."""
    df = spark.createDataFrame([(1, "u", "<p>short"), (2, "u", "<p>" + "long " * 30_000)], PAGES)
    seen = []
    monkeypatch.setattr(H, "labelled_pages", lambda texts: seen.append(len(texts)) or ["<p data-main=1>x"])
    H.train(df)
    H.train(df, sample_chars=200_000)
    assert seen == [1, 2]


def test_viterbi_equals_enumeration():
    rng = random.Random(1)
    for _ in range(50):
        change = np.array([[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        crf = H.Crf({"bias": 0.0}, change)
        s = [rng.uniform(-3, 3) for _ in range(rng.randint(0, 7))]

        def total(path):
            return sum(x for x, p in zip(s, path) if p) + sum(change[a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=len(s)), key=total)
        assert total(crf.decode(s)) == pytest.approx(total(best))


@pytest.fixture(scope="module")
def crf(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_held_out_blocks(crf):
    """Blocks of generated pages that training never saw."""
    right = n = 0
    for page in H.labelled_pages(["some other words, with sentences. And more of them."] * 3, 200, seed=77):
        cut = crf.blocks.cut(page)
        got = crf.decode(crf.emissions(cut))
        right += sum(g == (b[4] == "1") for g, b in zip(got, cut))
        n += len(cut)
    assert right / n > 0.97


def test_pages_with_marked_articles(spark, crf):
    """On pages with an article element, the main text is what it holds."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, crf).collect()}
    cutter = H.Blocks()
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = "\n".join(b[0] for b in cutter.cut(r.html) if "in:article" in b[2])
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_parts_that_are_not_main_text(crf):
    body = "<p>The first paragraph of this story has a few words, and it ends here.</p>" * 3
    page = (f"<header><h2>Site name</h2></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies. <button>OK</button></div>"
            f"<article><h1>Title</h1>{body}<aside>Related story of the day</aside><div class=advert>Buy this now</div></article>"
            f"<form class=newsletter><p>Get our letters by mail</p></form><section class=comments><p>I liked this story a lot, thanks.</p></section>"
            f"<aside class=sidebar><p>Popular today</p></aside><footer>&copy; Site</footer>")
    paragraph = "The first paragraph of this story has a few words, and it ends here."
    assert crf.extract(page) == "\n".join(["Title", *[paragraph] * 3])


def test_edges(spark, crf):
    rows = [(1, "u", None), (1, None, ""), (None, None, "<article><p>words of an article, here.</p></article>")] * 2
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract(df, crf).collect())
    assert got[:4] == [("1", "", 0)] * 4 and len(got) == 6
    empty = df.where("false")
    assert H.extract(empty, H.train(empty)).count() == 0


STRAY = [
    ('<p class=x">Hello there my friend.</p><p>Next one.</p>', ["Hello there my friend.", "Next one."]),
    ('<nav>Menu</nav><article><p class=lead">P one</p><p>P two</p><p id="z">End.</p></article>', ["Menu", "P one", "P two", "End."]),
    ("<p>One</p><p><a title=Bob's>Two</a></p><p>Three isn't lost</p>", ["One", "Two", "Three isn't lost"]),
    ("<p>A</p><!--><p>B</p><!-- x --!><p>C</p><!---><p>D</p><!-- <p>E</p> -- > --><p>F</p>", ["A", "B", "C", "D", "F"]),
    ("<p>A</ foo>B</>C<?php x ?>D<!x>E</p>", ["ABCDE"]),
    ('<p a = "x>y" b=\'<p>\' c d= e=>One</p><p/class=a/>Two<p =">Three', ["One", "Two", "Three"]),
    ("a < b and 1 <2 <- c</p><p>x <a href='y", ["a < b and 1 <2 <- c", "x"]),
    ('<p title="a"b="c">Q</p><p "x">R</p>', ["Q", "R"]),
    ("<svg><text><![CDATA[5 < 6 &amp; ]]></text></svg><p>T<![CDATA[x]]>U</p>", ["5 < 6 &amp;", "TU"]),
    ("<p>" + '<a href="' + "x" * 300000 + '">long</a>' + " y" * 100000, ["long" + " y" * 100000]),
]


@pytest.mark.parametrize("page,blocks", STRAY)
def test_stray_quotes_and_comments(page, blocks):
    assert [b[0] for b in H.Blocks().cut(page)] == blocks


def tokenized(page):
    """Text of a page by the states of HTML's tokenizer, one character at a time."""
    out, i, n = [], 0, len(page)
    white = " \t\n\f\r"
    while i < n:
        c = page[i]
        nxt = page[i + 1:i + 2]
        if c != "<" or not (nxt.isascii() and nxt.isalpha() or nxt in ("!", "?") and nxt or nxt == "/" and i + 2 < n):
            out.append(c)
            i += 1
            continue
        if nxt == "/" and page[i + 2] == ">":
            i += 3
            continue
        if page.startswith("<!--", i):
            i += 4
            if page.startswith(">", i) or page.startswith("->", i):
                i = page.index(">", i) + 1
                continue
            while i < n and not page.startswith("-->", i) and not page.startswith("--!>", i):
                i += 1
            i = page.index(">", i) + 1 if i < n else n
            continue
        name = i + 2 if nxt == "/" else i + 1
        if not (page[name].isascii() and page[name].isalpha()):
            i = page.find(">", name) + 1 or n
            continue
        i, state = name, "tag"
        while i < n and state != "end":
            c = page[i]
            i += 1
            if state in ("double", "single"):
                state = "before" if c == {"double": '"', "single": "'"}[state] else state
            elif state == "value":
                if c in white:
                    continue
                state = {'"': "double", "'": "single", ">": "end"}.get(c, "bare")
            elif c == ">":
                state = "end"
            elif state == "bare":
                state = "before" if c in white else "bare"
            elif c in white:
                state = {"name": "after", "after": "after"}.get(state, "before")
            elif c == "/":
                state = "before"
            elif state == "tag":
                pass
            elif c == "=" and state in ("name", "after"):
                state = "value"
            else:
                state = "name"
    return "".join(out)


def test_random_markup_against_the_states_of_html():
    rng = random.Random(11)
    bits = ["<p", "<b ", "</b>", "</p", ">", ">", ">", '"', "'", "=", " ", "/", "x", "class", "<!--", "-->", "--!>", "<!-->", "-", "!",
            "</ ", "</>", "<?", "<", "text", "\n", "a=b", 'c="d"', "e='f'", "g =h", "<i>", "</i>", "end."]
    cutter = H.Blocks()
    for _ in range(20000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(1, 25)))
        got = "".join("".join(b[0] for b in cutter.cut(page)).split())
        assert got == "".join(tokenized(page).split()), page
