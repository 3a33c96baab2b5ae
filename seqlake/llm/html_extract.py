"""Main text of web pages by a linear-chain CRF over DOM leaf blocks.

A page is cut into leaf blocks: the text between two block-level tag
boundaries.  Each block is described by its ancestors (tags, roles, class and id
words) and by its text (length, links, punctuation, capitals).  A two-state
conditional random field (main text or not) is trained by its likelihood on
labelled pages and decoded by Viterbi, so a block also speaks for its neighbours.

Labelled pages come from ``labelled_pages``: page skeletons of many kinds, with
and without telling tags and class names, filled with text blocks of a bounded
sample of the given pages; the labels are known by construction.

Text rules: character references are decoded, ``br`` and other inline tags do
not end a block, white space inside a block becomes one space, blocks are
trimmed and joined by a line feed.  Text that HTML takes as raw (``script``,
``style``, ``textarea``, ``title``, ``xmp``, ``iframe``, ``noembed``,
``noframes``) goes, to the end of the page only if its element never ends.
``svg`` and ``math`` stand within a block, their text included but for scripts,
styles and descriptions; a tag in them that ends in ``/>`` is empty, and an HTML
tag ends them where their end tag is missing.  Tags and comments begin and end
where HTML has it: stray quotes belong to names and values, ``<!-->`` and ``--!>``
end a comment, ``</ x>`` is one, and a tag or comment that the page does not end
goes.  Nothing else is dropped or cut.

Defined results: a NULL or empty page has an empty text; text outside any tag is
a block; unclosed and stray tags never fail; very long pages are cut in one pass
over their text; repeated rows each get a row; an
empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.llm.common import small_batches

#: Parameters of training: pages sampled for text, their longest, pages generated, passes.
SAMPLE_PAGES = 200
SAMPLE_CHARS = 100_000
TRAIN_PAGES = 600
STEPS = 150
SEED = 42

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em embed font i img input ins kbd label "
                   "link map mark meta nobr picture q ruby rb rt rp s samp small source span strike strong sub sup "
                   "time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
                     "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
            "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table dl html body div article section main aside nav footer header form td th".split())
FOREIGN = frozenset(("svg", "math"))
# elements of svg and math that hold HTML, and those whose text is not shown
HOLDS_HTML = frozenset("foreignobject annotation-xml mi mo mn ms mtext".split())
NOT_SHOWN = frozenset("script style title desc metadata".split())
# HTML elements that end svg and math; no element of those has such a name
BREAKS_OUT = CLOSES_P | SCOPE | frozenset(SIBLINGS) | frozenset(
    "b big br code em embed head i img listing meta nobr ruby s small span strike strong sub sup tt u var".split())

#: Class and id words that tell a block's role, by the parts they contain.
ROLES = {
    "menu": ("nav", "menu", "breadcrumb", "pagination", "pager", "toc", "tabs", "skip"),
    "ad": ("ads", "advert", "sponsor", "promo", "banner", "adbox", "adsense", "affiliate"),
    "comment": ("comment", "repl", "disqus", "discuss", "respond", "feedback"),
    "side": ("side", "aside", "related", "widget", "recommend", "popular", "trending", "rail"),
    "foot": ("foot", "copyright", "legal", "colophon", "imprint"),
    "head": ("masthead", "header", "topbar", "logo", "branding"),
    "notice": ("cookie", "consent", "notice", "alert", "popup", "modal", "gdpr", "paywall", "overlay", "warning"),
    "form": ("form", "search", "login", "subscribe", "newsletter", "signup"),
    "share": ("share", "social", "follow", "tags", "meta", "byline"),
    "main": ("content", "article", "post", "entry", "story", "main", "text", "body"),
}

# A tag as HTML reads it: a quote opens a string only after "=", elsewhere it is part of a name or a value.
_W = r"[ \t\n\f\r]"
_ATTRIBUTE = (rf"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{_W}*+={_W}*+(?:\"([^\"]*)\"|'([^']*)'"
              rf"|([^ \t\n\f\r\"'>][^ \t\n\f\r>]*+)|(?=>|\Z))|(?!{_W}*+=))")
_ATTR = re.compile(_ATTRIBUTE)
_TAG = re.compile(rf"</?([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*+)>")
# Comments may end at once and with "--!>"; what starts like a tag but cannot be one is a comment up to the next ">".
_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|</?[a-zA-Z].*\Z", re.S)
_CDATA = "<![CDATA["
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}
_CLOSING = frozenset(".!?:;\"'”’…。！？»")


def _tag_features(tag: str, attributes: str) -> tuple[frozenset, str | None]:
    """Features of an element, and its training label if it carries one."""
    out, label = {f"in:{tag}"}, None
    if attributes:
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                for word in _PART.findall(value):
                    word = word.lower()
                    if word in ("ad", "ads"):
                        out.add("role:ad")
                    out |= {f"role:{r}" for r, parts in ROLES.items() if any(p in word for p in parts)}
            elif name == "role":
                out.add(f"aria:{value.lower()}")
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
            elif name == "data-main":
                label = value
    return frozenset(out), label


class Blocks:
    """Cuts pages into leaf blocks; remembers the features of tags it has seen."""

    def __init__(self):
        self.seen: dict[str, tuple] = {}

    def _tag(self, raw: str, m: re.Match):
        got = self.seen.get(raw)
        if got is None:
            tag = m[1].lower()
            got = (tag, *_tag_features(tag, m[2]))
            if len(self.seen) < 50_000:
                self.seen[raw] = got
        return got

    def cut(self, page: str) -> list[tuple]:
        """``(text, own tag, ancestor features, share of linked characters, label)`` in page order."""
        out, text, linked, in_link = [], [], 0, 0
        alien: list[str] = []   # open elements of svg and math
        stack = [("", frozenset(), None)]

        def flush():
            nonlocal linked
            if text:
                s = " ".join("".join(text).split())
                if s:
                    tag, features, label = stack[-1]
                    out.append((s, tag, features, min(1.0, linked / len(s)), label))
                text.clear()
                linked = 0

        def close(tags) -> None:
            """Drop everything from the innermost element of ``tags`` on, unless a scope is in between."""
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    del stack[k:]
                    return
                if stack[k][0] in SCOPE:
                    return

        def add(raw: str, plain: bool = False) -> None:
            nonlocal linked
            if alien and not NOT_SHOWN.isdisjoint(alien):
                return
            s = entities.unescape(raw) if "&" in raw and not plain else raw
            text.append(s)
            if in_link:
                linked += len(s.strip())

        at, n = 0, len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                add(page[at:])
                break
            if lt > at:
                add(page[at:lt])
            m = _TAG.match(page, lt)
            if m is None:
                if alien and page.startswith(_CDATA, lt):
                    end = page.find("]]>", lt)
                    end = n if end < 0 else end
                    add(page[lt + len(_CDATA):end], plain=True)
                    at = end + 3
                    continue
                m = _MARKUP.match(page, lt)
                if m is None:      # a bare "<"
                    add("<")
                    at = lt + 1
                else:
                    at = m.end()
                continue
            at = m.end()
            ending = page[lt + 1] == "/"
            tag, features, label = self._tag(m[0], m)
            if alien:
                if ending:
                    if tag in alien:
                        while alien.pop() != tag:
                            pass
                        continue
                    if alien[-1] not in HOLDS_HTML:
                        alien.clear()
                elif alien[-1] not in HOLDS_HTML:
                    if tag not in BREAKS_OUT:
                        if m[0][-2] != "/":
                            alien.append(tag)
                        continue
                    while alien and alien[-1] not in HOLDS_HTML:
                        alien.pop()
            if tag in FOREIGN:
                if not ending and m[0][-2] != "/":
                    alien.append(tag)
                continue
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                elif tag == "a":
                    in_link = 0 if ending else 1
                continue
            if tag in RAW:
                if not ending:
                    end = _RAW_END[tag].search(page, at)
                    stop = page.find(">", end.start()) if end else -1
                    at = stop + 1 if stop >= 0 else n
                flush()
                continue
            flush()
            in_link = 0
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if tag in CLOSES_P:
                close({"p"})
            elif tag in SIBLINGS:
                close(SIBLINGS[tag])
            if tag not in VOID:
                _, above, above_label = stack[-1]
                stack.append((tag, above | features, above_label if label is None else label))
        flush()
        return out


def text_features(text: str, tag: str, linked: float, place: float) -> list[str]:
    words = text.count(" ") + 1
    capitals = sum(map(str.isupper, text))
    out = [f"tag:{tag}", f"words:{min(words.bit_length(), 8)}", f"linked:{int(linked * 3)}",
           f"place:{int(place * 5)}"]
    if text[-1] in _CLOSING:
        out.append("closed")
        if words > 8:
            out.append("sentence")
    if "©" in text or "(c)" in text:
        out.append("copyright")
    if 2 * capitals > len(text):
        out.append("capitals")
    if "," in text:
        out.append("comma")
    return out


class Crf:
    """Two states; weights of state 1 against state 0, and the transitions."""

    def __init__(self, weights: dict[str, float], change: np.ndarray):
        self.weights, self.change = weights, change.tolist()
        self.known: dict[frozenset, float] = {}
        self.blocks = Blocks()

    def emissions(self, cut: list[tuple]) -> list[float]:
        out, w = [], self.weights
        for k, (text, tag, features, linked, _) in enumerate(cut):
            above = self.known.get(features)
            if above is None:
                above = sum(w.get(f, 0.0) for f in features)
                if len(self.known) < 50_000:
                    self.known[features] = above
            out.append(above + sum(w.get(f, 0.0) for f in text_features(text, tag, linked, k / len(cut))) + w["bias"])
        return out

    def decode(self, scores: list[float]) -> list[int]:
        """The best state sequence (Viterbi)."""
        (c00, c01), (c10, c11) = self.change
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores):
            if k == 0:
                a, b = 0.0, s
                continue
            from0, from1 = (0, a + c00) if a + c00 >= b + c10 else (1, b + c10), (0, a + c01) if a + c01 > b + c11 else (1, b + c11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + s
        state = int(b > a)
        out = [state] if scores else []
        for pair in reversed(back):
            state = pair[state]
            out.append(state)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        """The main text of one page."""
        cut = self.blocks.cut(page or "")
        states = self.decode(self.emissions(cut))
        return "\n".join(c[0] for c, s in zip(cut, states) if s)


def fit(pages: list[str], steps: int = STEPS, penalty: float = 0.02) -> Crf:
    """Train on labelled pages (elements carry ``data-main="1"`` or ``"0"``) by conditional likelihood."""
    cutter = Blocks()
    cuts = [c for c in (cutter.cut(p) for p in pages) if c]
    names: dict[str, int] = {}
    rows, cols, longest = [], [], max(map(len, cuts))
    y = np.zeros((len(cuts), longest), dtype=int)
    real = np.zeros((len(cuts), longest), dtype=bool)
    for i, cut in enumerate(cuts):
        for k, (text, tag, features, linked, label) in enumerate(cut):
            y[i, k], real[i, k] = label == "1", True
            for f in ("bias", *features, *text_features(text, tag, linked, k / len(cut))):
                rows.append(i * longest + k)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    lengths = real.sum(axis=1)
    w = np.zeros(len(names) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        emit = np.zeros((len(cuts), longest, 2))
        emit[:, :, 1] = np.bincount(rows, w[cols], y.size).reshape(y.shape)
        change = w[-4:].reshape(2, 2)
        # forward and backward sums, all pages side by side
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(fwd[:, t - 1, :1] + change[:1], fwd[:, t - 1, 1:] + change[1:]) + emit[:, t]
            fwd[:, t] = np.where(real[:, t, None], moved, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + bwd[:, t + 1]
            moved = np.logaddexp(change[None, :, 0] + ahead[:, :1], change[None, :, 1] + ahead[:, 1:])
            bwd[:, t] = np.where(real[:, t + 1, None], moved, 0.0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(np.clip(fwd[:, :, 1] + bwd[:, :, 1] - total[:, None], -60, 0)) * real
        grad = np.zeros_like(w)
        grad[:-4] = np.bincount(cols, (p1 - y).ravel()[rows], len(names))
        both = (real[:, 1:])[..., None, None]
        pair = fwd[:, :-1, :, None] + change + emit[:, 1:, None, :] + bwd[:, 1:, None, :] - total[:, None, None, None]
        pair = np.exp(np.clip(pair, -60, 0)) * both
        grad[-4:] = pair.sum(axis=(0, 1)).ravel()
        for a in (0, 1):
            for b in (0, 1):
                grad[len(names) + 2 * a + b] -= ((y[:, :-1] == a) & (y[:, 1:] == b) & real[:, 1:]).sum()
        grad = grad / lengths.sum() + penalty / len(cuts) * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Crf({f: float(w[k]) for f, k in names.items()}, w[-4:].reshape(2, 2))


class _Maker:
    """Builds labelled pages from text blocks."""

    def __init__(self, texts: list[str], seed: int):
        self.rng = random.Random(seed)
        self.texts = texts or ["plain words of a page"]

    def some(self, low: int, high: int) -> str:
        """``low`` to ``high`` words of some text."""
        words = self.rng.choice(self.texts).split()
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(words) - n + 1))
        return entities.escape(" ".join(words[at:at + n]) or "words")

    def open(self, tags, classes, chance: float = 0.7) -> tuple[str, str]:
        tag = self.rng.choice(tags)
        named = f' {self.rng.choice(["class", "id"])}="{self.rng.choice(classes)}"' if self.rng.random() < chance else ""
        return f"<{tag}{named}", f"</{tag}>"

    def links(self, n: int) -> str:
        kind = self.rng.choice(["li", "div", "span", "a"])
        one = lambda: f'<a href="/{self.rng.randrange(999)}">{self.some(1, 4)}</a>'
        if kind == "li":
            return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
        return "".join(f"<{kind}>{one()}</{kind}>" if kind != "a" else one() + " " for _ in range(n))

    def aside(self, kind: str) -> str:
        """A part that is not main text."""
        r = self.rng
        if kind == "menu":
            a, z = self.open(["nav", "nav", "div", "ul", "header"], ["nav", "menu", "navbar", "main-nav", "breadcrumbs", "site-menu"])
            return f"{a} data-main=\"0\">{self.links(r.randint(2, 9))}{z}"
        if kind == "head":
            a, z = self.open(["header", "header", "div"], ["header", "masthead", "site-header", "topbar", "logo"])
            return f"{a} data-main=\"0\"><{(t := r.choice(['h1', 'div', 'p', 'h2']))}>{self.some(1, 5)}</{t}>{self.links(r.randint(0, 4))}{z}"
        if kind == "foot":
            a, z = self.open(["footer", "footer", "footer", "div"], ["footer", "site-footer", "copyright", "legal", "colophon"], 0.6)
            return f"{a} data-main=\"0\">{r.choice(['&copy; ', '', '<p>© '])}{self.some(2, 25)}{self.links(r.randint(0, 3)) if r.random() < .4 else ''}{z}"
        if kind == "side":
            a, z = self.open(["aside", "aside", "div", "section"], ["sidebar", "related", "widget", "side", "recommended", "trending"])
            inner = "".join(f"<{(t := r.choice(['h3', 'p', 'div', 'li']))}>{self.some(2, 20)}</{t}>" for _ in range(r.randint(1, 4)))
            return f"{a} data-main=\"0\">{inner}{self.links(r.randint(0, 4))}{z}"
        if kind == "ad":
            a, z = self.open(["div", "div", "aside", "section", "p"], ["ad", "ads", "advert", "ad-box", "banner", "sponsored", "promo"], 1.0)
            return f"{a} data-main=\"0\">{self.some(2, 30)}{z}"
        if kind == "notice":
            a, z = self.open(["div", "div", "section", "p", "noscript", "dialog"], ["cookie", "cookie-notice", "notice", "alert", "consent", "popup"], 1.0)
            return f"{a}{r.choice(['', '', ' role=alert'])} data-main=\"0\">{self.some(4, 30)} <button>{self.some(1, 2)}</button>{z}"
        if kind == "form":
            a, z = self.open(["form", "form", "form", "div"], ["search", "newsletter", "login-form", "subscribe", "signup"], 0.6)
            return f"{a} data-main=\"0\"><label>{self.some(1, 5)}</label><input name=q><p>{self.some(2, 15)}</p><button>{self.some(1, 2)}</button>{z}"
        if kind == "share":
            a, z = self.open(["div", "footer", "ul", "p"], ["share", "social", "tags", "post-meta", "byline"], 1.0)
            return f"{a} data-main=\"0\">{self.some(1, 8)} {self.links(r.randint(1, 3))}{z}"
        a, z = self.open(["section", "div", "div", "ol", "aside"], ["comments", "comment-list", "replies", "reader-comments", "discussion", "disqus"], 1.0)
        inner = "".join(f"<{(t := r.choice(['p', 'div', 'li', 'article']))}{r.choice(['', ' class=comment', ' class=reply'])}>{self.some(3, 60)}</{t}>"
                        for _ in range(r.randint(1, 5)))
        return f"{a} data-main=\"0\"><h3>{self.some(1, 3)}</h3>{inner}{z}"

    def article(self) -> str:
        r = self.rng
        a, z = self.open(["article", "article", "main", "div", "section", "td"],
                         ["content", "post", "article-body", "entry-content", "story", "main", "text"], 0.4)
        if a.startswith(("<div", "<section", "<td")) and " " not in a:
            a = f'<div class="{r.choice(["content", "post-body", "article", "entry", "story-text"])}"'
            z = "</div>"
        out = [f"{a} data-main=\"1\">"]
        if r.random() < 0.8:
            head = f"<h1>{self.some(1, 12)}</h1>"
            out.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
        extra = [k for k in ("ad", "side", "share", "form", "menu", "notice", "comments") if r.random() < 0.1]
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 15])
        spots = {r.randrange(n + 1): k for k in extra}
        for k in range(n + 1):
            if k in spots and k:
                out.append(self.aside(spots[k]))
            if k == n:
                break
            text = self.some(*r.choice([(1, 3), (3, 12), (10, 60), (40, 200)]))
            kind = r.random()
            if kind < 0.6:
                out.append(f"<p>{text}{r.choice(['</p>', '</p>', '</p>', '<br>', ''])}")
            elif kind < 0.7:
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.78:
                out.append(f"<h2>{self.some(1, 8)}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.some(2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{self.some(1, 5)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.97:
                out.append(f"<pre>{text}</pre>")
            else:
                out.append(f"<p>{self.some(2, 9)} <a href='/x'>{self.some(2, 5)}</a> {text}</p>")
        return "".join(out) + z

    def page(self) -> str:
        r = self.rng
        parts = [self.aside(k) for k in ("notice", "head", "menu", "form", "ad") if r.random() < 0.4]
        r.shuffle(parts)
        after = [self.aside(k) for k in ("side", "ad", "comments", "share", "form", "menu") if r.random() < 0.35]
        r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.aside("foot"))
        body = "".join([*parts, self.article(), *after])
        if r.random() < 0.3:
            body = f"<div{r.choice(['', ' id=wrapper', ' class=container', ' class=page'])}>{body}</div>"
        return f"<html><head><title>{self.some(1, 9)}</title></head><body>{body}</body></html>"


def labelled_pages(texts: list[str], n: int = TRAIN_PAGES, seed: int = SEED) -> list[str]:
    """``n`` pages whose main text is marked ``data-main="1"``, other parts ``"0"``."""
    maker = _Maker(texts, seed)
    return [maker.page() for _ in range(n)]


def train(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES,
          sample_chars: int = SAMPLE_CHARS) -> Crf:
    """A CRF trained on pages built from the text blocks of a bounded sample of ``pages``.

    The sample comes to the driver: ``sample_pages`` pages of at most ``sample_chars`` characters
    (longer pages give no training text, but are extracted as all others).
    """
    rows = (pages.select(F.col(html_col).alias("h")).where(F.length("h").between(1, sample_chars))
            .orderBy(F.xxhash64("h"), "h").limit(sample_pages).collect())
    cutter = Blocks()
    texts = [c[0] for r in rows for c in cutter.cut(r.h)]
    return fit(labelled_pages(texts))


def extract(pages: DataFrame, crf: Crf, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars``: one row per page."""
    small_batches(pages.sparkSession)
    weights, change = crf.weights, np.array(crf.change)
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches):
        own = Crf(weights, change)
        for b in batches:
            texts = [own.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
