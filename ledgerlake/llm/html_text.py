"""Main text of web pages: gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into its block elements. Each gets features of its subtree (text, link and tag density), its tag and
attribute tokens and those of its ancestors, its depth and its siblings. Trees fitted by Spark's ``GBTClassifier``
give each node the odds of being article text, and a dynamic programme over the tree picks the likeliest choice in
which nothing below a dropped node is kept.

No page is labelled, so training pages are composed: text blocks of a bounded sample of pages are set into layouts of
many kinds (with semantic tags, with telling attributes, with neither) together with menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, whose place in the tree is then known.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import few_parts, materialize, slices
from ledgerlake.llm.quality_model import Trees

HIDDEN = {"script", "style", "head", "title", "template", "noscript", "iframe", "svg", "object"}
#: Start tags that can stand in head; any other ends it, as its end tag may be left out.
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var",
}
#: Start tags that end an open element of these kinds, up to the nearest element of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TAG_KINDS = [{"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "button", "select", "textarea", "fieldset", "label", "input", "option", "legend"}, {"article", "main"}, {"div", "section", "body", "html"}, {"p", "blockquote", "pre"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dt", "dd"}, {"table", "tr", "td", "th", "tbody", "thead"}]
TOKEN_KINDS = [
    {"article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toc", "links"},
    {"header", "head", "masthead", "topbar", "top", "logo", "branding", "toolbar"},
    {"footer", "foot", "bottom", "copyright", "colophon", "legal", "contentinfo"},
    {"sidebar", "side", "aside", "rail", "complementary", "widget", "widgets", "related", "recommended", "more", "trending", "popular", "share", "social"},
    {"notice", "cookie", "cookies", "consent", "gdpr", "alert", "banner", "modal", "popup", "overlay", "announcement", "warning", "paywall", "newsletter", "subscribe", "subscription", "signup"},
    {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "promoted", "dfp", "commercial"},
    {"form", "search", "login", "signin", "register", "contact", "input", "field"},
    {"comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "responses", "reader", "feedback", "review", "reviews"},
]
_TOKEN_KIND = {t: i for i, kind in enumerate(TOKEN_KINDS) for t in kind}
_TAG_KIND = {t: i for i, kind in enumerate(TAG_KINDS) for t in kind}
_BLOCKS = set(_TAG_KIND) | {"address", "center", "details", "dialog", "figcaption", "figure", "hr", "summary"}
#: Start tags that end a hidden element whose own end tag is missing; None: any, for what holds no elements.
_FREES = {"iframe": None, "title": None, "noscript": _BLOCKS, "object": _BLOCKS, "template": _BLOCKS, "svg": _BLOCKS | VOID | INLINE - {"a"}}
_BREAK = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


LIKELY = 0.2  # a node of less probability than this is open at a cost


class Node:
    __slots__ = ("tag", "parent", "kids", "kinds", "above", "depth", "runs", "chars", "words", "linked", "links", "stops", "tags", "n_runs", "start", "own", "label", "hidden", "ended", "veil", "cover")

    def __init__(self, tag: str, parent: Node | None, kinds: int, label: str | None):
        self.tag, self.parent, self.kinds, self.label = tag, parent, kinds, label
        self.kids: list[Node] = []
        self.runs: list[list] = []  # [place in the page, pieces of text, characters inside links]
        self.depth = parent.depth + 1 if parent else 0
        self.cover: Node | None = self if tag in HIDDEN else parent and parent.cover  # the nearest hidden element
        self.hidden = self.cover is not None
        self.ended, self.veil = False, -1  # by its own end tag; place among the hidden elements
        self.above = parent.above | parent.kinds if parent else 0
        self.chars = self.words = self.linked = self.links = self.stops = self.tags = self.n_runs = self.start = self.own = 0
        if parent:
            parent.kids.append(self)


class Page(HTMLParser):
    """The tree of a page's block elements; whatever is left open or cut off ends with the page.

    Head ends with the first tag or text that can't stand in it. Of a hidden element without its own end tag only what
    precedes the next block is hidden; such elements are known once the page was read, which is then read again. (An
    open script or style hides the rest, which can't be told from code.)
    """

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.unended: set[int] = set()  # places of such elements among the hidden ones
        self.read(text)
        self.unended = {i for i, n in enumerate(self.veils) if n.tag in _FREES and not n.ended}
        if self.unended:
            self.reset()
            self.read(text)

    def read(self, text: str) -> None:
        self.root = self.at = Node("#page", None, 0, None)
        self.nodes, self.veils, self.place, self.in_link, self.fresh = [self.root], [], 0, 0, True
        self.feed(text)
        self.close()

    def leave_hidden(self, tag: str) -> None:
        """End the hidden elements that this start tag (or text: #text) can't stand in."""
        while self.at.hidden:
            n = self.at.cover
            if n.tag == "head":
                ends = tag not in IN_HEAD
            else:
                ends = n.tag in _FREES and n.veil in self.unended and (_FREES[n.tag] is None or tag in _FREES[n.tag])
            if not ends:
                return
            self.at, self.fresh, self.in_link = n.parent, True, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.leave_hidden(tag)
        if tag == "a":
            self.in_link += 1
            self.at.links += 1
        if tag == "br" and not self.fresh:
            self.handle_data(" ")
        if tag in INLINE or tag in VOID:
            self.at.tags += 1
            if tag == "hr":
                self.fresh = True
            return
        ends, until = ENDS.get(tag, ({"p"}, {"button", "table", "object"}))
        n = self.at
        while n is not self.root and n.tag not in until:
            if n.tag in ends:
                self.at = n.parent
                break
            if tag not in ENDS and n.tag != "p":
                break
            n = n.parent
        kinds, label = 0, None
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for t in _BREAK.split(v):
                    if (i := _TOKEN_KIND.get(t.lower())) is not None:
                        kinds |= 1 << i
            elif k == "data-known":
                label = v
        if (i := _TAG_KIND.get(tag)) is not None:
            kinds |= 1 << (len(TOKEN_KINDS) + i)
        self.at = Node(tag, self.at, kinds, label)
        self.nodes.append(self.at)
        if tag in HIDDEN:
            self.at.veil = len(self.veils)
            self.veils.append(self.at)
        self.fresh, self.in_link = True, 0

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in INLINE or tag in VOID:
            return
        n = self.at
        while n is not self.root:
            if n.tag == tag:
                n.ended = True
                self.at, self.fresh, self.in_link = n.parent, True, 0
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and not data.isspace():
            self.leave_hidden("#text")
        if self.at.hidden:
            return
        if self.fresh:
            if data.isspace():
                return
            self.place += 1
            self.at.runs.append([self.place, [], 0])
            self.fresh = False
        run = self.at.runs[-1]
        run[1].append(data)
        if self.in_link:
            run[2] += len(data)


_ALL_KINDS = len(TOKEN_KINDS) + len(TAG_KINDS)
N_FEATURES = 20 + 2 * _ALL_KINDS


def measure(page: Page) -> np.ndarray:
    """Features of every node of a page, in the order of ``page.nodes``; texts of runs are settled on the way."""
    total = 0
    for n in page.nodes:
        n.start = total
        kept = []
        for place, pieces, linked in n.runs:
            text = " ".join("".join(pieces).split())
            if text:
                kept.append((place, text))
                n.own += len(text)
                n.words += text.count(" ") + 1
                n.linked += min(linked, len(text))
                n.stops += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                n.n_runs += 1
        n.runs, n.chars = kept, n.own
        total += n.own
    for n in reversed(page.nodes[1:]):  # children come after their parents
        p = n.parent
        if n.hidden:
            continue
        p.chars += n.chars
        p.words += n.words
        p.linked += n.linked
        p.links += n.links
        p.stops += n.stops
        p.tags += n.tags + 1
        p.n_runs += n.n_runs
    x = np.zeros((len(page.nodes), N_FEATURES))
    log, whole = math.log1p, max(total, 1)
    bits_own, bits_above = np.array([n.kinds for n in page.nodes], np.int64), np.array([n.above for n in page.nodes], np.int64)
    each = np.arange(_ALL_KINDS)
    x[:, 20 : 20 + _ALL_KINDS] = bits_own[:, None] >> each & 1
    x[:, 20 + _ALL_KINDS :] = bits_above[:, None] >> each & 1
    for row, n in zip(x, page.nodes, strict=True):
        p = n.parent or n
        row[:20] = (
            n.depth, log(n.chars), log(n.words), n.linked / max(n.chars, 1), log(n.links), n.stops / max(n.words, 1), log(n.tags), n.chars / max(n.n_runs, 1), log(n.own), n.chars / whole,
            log(len(p.kids)), n.chars / max(p.chars, 1), n.start / whole, n.chars / (n.tags + 1), log(p.chars), p.linked / max(p.chars, 1), p.chars / max(p.n_runs, 1),
            p.stops / max(p.words, 1), log(p.links), log(n.n_runs),
        )
    return x


def decode(nodes: list[Node], p: np.ndarray, *, open_cost: float = 0.5, hole_cost: float = 3.0) -> list[str]:
    """Text runs of the kept nodes, in page order.

    A node is kept, dropped, or (without text of its own) open, which decides nothing. Below a dropped node everything
    is dropped; below a kept one nodes are kept, or dropped at ``hole_cost``. The choice of greatest likelihood wins.
    """
    at = {id(n): i for i, n in enumerate(nodes)}
    logs = np.log(np.clip(p, 1e-4, 1 - 1e-4)), np.log(np.clip(1 - p, 1e-4, 1 - 1e-4))
    yes, no = logs[0].tolist(), logs[1].tolist()
    # a node that looks like anything but article can't well be open; what holds the whole page always can
    doubt = [0.0 if n.tag in ("#page", "html", "body") else min(0.0, y - math.log(LIKELY)) for n, y in zip(nodes, yes, strict=True)]
    kept, dropped, opened = yes[:], no[:], [d - open_cost for d in doubt]
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        if n.hidden or not n.chars:
            continue
        j = at[id(n.parent)]
        dropped[j] += dropped[i]
        kept[j] += max(kept[i], dropped[i] - hole_cost)
        opened[j] += max(kept[i], dropped[i], opened[i] if not n.own else -math.inf)
    out: list[tuple[int, str]] = []
    todo = [(nodes[0], "open")]
    while todo:
        n, state = todo.pop()
        if state == "kept":
            out += n.runs
        for k in n.kids:
            if k.hidden or not k.chars:
                continue
            i = at[id(k)]
            if state == "kept":
                then = "kept" if kept[i] >= dropped[i] - hole_cost else "dropped"
            else:
                then = max(("kept", kept[i]), ("dropped", dropped[i]), ("open", opened[i] if not k.own else -math.inf), key=lambda s: s[1])[0]
            if then != "dropped":
                todo.append((k, then))
    return [t for _, t in sorted(out)]


# ---- training pages -----------------------------------------------------------------------------------


def compose(blocks: list[str], r: random.Random) -> str:
    """A page around these blocks; the attribute data-known tells article nodes (1) from others (0)."""
    e = html.escape
    words = [w for b in blocks for w in b.split()] or ["text"]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    sentence = lambda: e(r.choice(blocks) if r.random() < 0.3 else some(3, 25) + ".")
    mute = r.random() < 0.25  # a page whose attributes tell nothing

    def box(tags: list[str], kind: int, inside: str, known: int) -> str:
        tag = r.choice(tags)
        name = r.choice(sorted(TOKEN_KINDS[kind]))
        told = not mute and (tag in ("div", "section", "ul", "p") or r.random() < 0.5)
        name = f"{r.choice(['', 'site-', 'c-', 'js-'])}{name}{r.choice(['', '-box', '-1', '_wrap', 'Area'])}" if told else f"c{r.randint(1, 99)}"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}" data-known="{known}">{inside}</{tag}>'

    par = lambda t, known: f'<p data-known="{known}">{t}' + ("</p>" if r.random() < 0.8 else "")
    links = lambda: "<ul data-known=\"0\">" + "".join(f'<li data-known="0"><a href="/{i}">{e(some(1, 4))}</a></li>' for i in range(r.randint(2, 12))) + "</ul>"
    plain_tags = ["div", "section"]

    def comments() -> str:
        each = "".join(f'<{t} class="{r.choice(["comment", "reply", "user-comment"])}" data-known="0"><p data-known="0">{e(some(1, 2))}: {sentence()}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6)))
        return box(plain_tags, 8, f'<h3 data-known="0">{e(some(1, 2))}</h3>' + each, 0) if not mute else ""

    def special(block: str) -> str:
        """A list, table, figure, quotation, code or definition list of the article, with the block's words as its text."""
        words, own = block.split(), lambda tag, inside: f'<{tag} data-known="1">{inside}</{tag}>'
        n = r.randint(1, min(6, max(1, len(words))))
        cuts = sorted(r.sample(range(1, len(words)), min(n, len(words)) - 1)) if len(words) > 1 else []
        parts = [e(" ".join(words[a:b])) for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True)]
        kind = r.choice(["ul", "ol", "table", "figure", "blockquote", "pre", "dl"])
        if kind in ("ul", "ol"):
            return own(kind, "".join(own("li", x) for x in parts))
        if kind == "table":
            wide = r.randint(1, 4)
            return own("table", "".join(own("tr", "".join(own(r.choice(["td", "td", "th"]), x) for x in parts[i : i + wide])) for i in range(0, len(parts), wide)))
        if kind == "figure":
            return own("figure", '<img src="i.png">' + own("figcaption", e(block)))
        if kind == "dl":
            return own("dl", "".join(own(("dt", "dd")[i % 2], x) for i, x in enumerate(parts)))
        return own(kind, e(block) if kind == "pre" or r.random() < 0.5 else own("p", e(block)))

    modules = {
        "nav": lambda: box(["nav", "div", "nav"], 1, links(), 0),
        "header": lambda: box(["header", "div"], 2, f'<h2 data-known="0"><a href="/">{e(some(1, 3))}</a></h2>' + (links() if r.random() < 0.5 else par(sentence(), 0)), 0),
        "footer": lambda: box(["footer", "div"], 3, (par(sentence(), 0) if r.random() < 0.5 else f"&copy; {sentence()}") + (links() if r.random() < 0.4 else ""), 0),
        "side": lambda: box(["aside", "div"], 4, f'<h3 data-known="0">{e(some(1, 3))}</h3>' + r.choice([links, lambda: par(sentence(), 0)])(), 0),
        "notice": lambda: box(["div", "section", "p"], 5, sentence(), 0) if not mute else "",
        "ad": lambda: box(["div", "section", "aside"], 6, sentence() if r.random() < 0.6 else par(sentence(), 0), 0) if not mute else "",
        "form": lambda: f'<form data-known="0"><label data-known="0">{e(some(1, 3))}</label><input><button data-known="0">{e(some(1, 2))}</button></form>',
        "comments": comments,
    }
    body = [par(e(b), 1) for b in blocks]
    for i in range(1, len(blocks)):  # some blocks of an article are no plain paragraphs
        if r.random() < 0.2:
            body[i] = special(blocks[i])
    if r.random() < 0.25:  # semantic tags without attributes: only structure tells
        tag = r.choice(["article", "main"])
        bare = {
            "nav": lambda: f'<nav data-known="0">{links()}</nav>',
            "header": lambda: f'<header data-known="0"><h2 data-known="0">{e(some(1, 4))}</h2>{r.choice(["", par(sentence(), 0)])}</header>',
            "aside": lambda: f'<aside data-known="0">{r.choice([links(), par(sentence(), 0)])}</aside>',
            "footer": lambda: f'<footer data-known="0">{r.choice(["", "&copy; "])}{r.choice([sentence(), par(sentence(), 0)])}</footer>',
            "ad": lambda: modules["ad"]() or f'<aside data-known="0">{sentence()}</aside>',
            "form": modules["form"],
        }
        heading = r.choice(["", f'<h1 data-known="1">{e(r.choice([some(2, 10), " ".join(blocks[0].split()[:10])]))}</h1>'])
        before = "".join(bare[m]() for m in ("header", "nav", "ad", "aside", "form") if r.random() < 0.5)
        after = "".join(bare[m]() for m in ("ad", "aside", "nav", "footer") if r.random() < 0.5)
        return f'<html><body>{before}<{tag} data-known="1">{heading}{"".join(body)}</{tag}>{after}</body></html>'
    if r.random() < 0.3:
        body.insert(r.randint(0, len(body)), f'<h2 data-known="1">{e(some(1, 6))}</h2>')
    inner = r.choices(["ad", "notice", "side", "form", "none"], [4, 2, 2, 1, 6])[0]
    if inner != "none":
        body.insert(r.randint(0, len(body)), modules[inner]())
    title = f'<h1 data-known="1">{e(some(2, 10))}</h1>' if r.random() < 0.8 else ""
    article = box(["article", "main", "div", "section", "div"], 0, title + "".join(body), 1)
    before = [modules[m]() for m in ("header", "nav", "notice", "ad", "side", "form") if r.random() < 0.5]
    after = [modules[m]() for m in ("ad", "comments", "side", "nav", "form", "footer", "notice") if r.random() < 0.5]
    if r.random() < 0.4:
        article = f'<div class="{r.choice(["row", "wrap", "page", "container"])}">{article}{modules["side"]()}</div>'
    return f"<html><body>{''.join(before)}{article}{''.join(after)}</body></html>"


def fit(pages: DataFrame, *, html_col: str = "html", most_pages: int = 400, layouts: int = 5, trees: int = 40, depth: int = 5) -> Trees:
    """Trees fitted on ``layouts`` composed pages for each of about ``most_pages`` pages at most, chosen by a hash of the page."""
    one = pages.select(F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    n = one.count()
    share = min(1.0, most_pages / max(n, 1))
    chosen = one.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) <= int(share * (1 << 20))).dropDuplicates(["html"])  # copies of a page are chosen together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("html").to_pylist():
                page = Page(text)
                measure(page)
                blocks = [t for node in page.nodes for _, t in node.runs] or ["text"]
                r = random.Random(len(text) * 31 + len(blocks))
                xs, ys = [], []
                for _ in range(layouts):
                    own = r.sample(blocks, min(len(blocks), r.choice([1, 1, 2, 3, 5, 8, 13, 20])))
                    if r.random() < 0.25:  # articles of a line or two
                        own = [" ".join(b.split()[: r.randint(1, 8)]) for b in own[:2]]
                    made = Page(compose(own, r))
                    x = measure(made)
                    known = [i for i, node in enumerate(made.nodes) if node.label is not None]
                    xs += list(x[known])
                    ys += [int(made.nodes[i].label) for i in known]
                yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.float64()))], ["label", "x"])

    rows = materialize(chosen.mapInArrow(run, "label int, x array<double>"), "training-nodes")
    if rows.select("label").distinct().count() < 2:
        return Trees([], [], 0, 0.5)
    data = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    return Trees.of(GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, minInstancesPerNode=5, featureSubsetStrategy="all", seed=1).fit(few_parts(data)))


def main_texts(htmls: list[str], model: Trees) -> list[str]:
    pages = [Page(h) for h in htmls]
    x = [measure(p) for p in pages]
    p = model.score(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for page, rows in zip(pages, x, strict=True):
        out.append("\n".join(decode(page.nodes, p[at : at + len(rows)])))
        at += len(rows)
    return out


def extract(pages: DataFrame, model: Trees | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **fitting) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if there is none), n_chars.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
    page order by one line feed. Null html counts as empty; null ids and urls stay null; repeated rows are extracted
    each; an empty table gives no rows; other columns are not read. Pages are whole, however long; no shuffle.
    """
    model = model or fit(pages, html_col=html_col, **fitting)
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = main_texts(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return d.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
