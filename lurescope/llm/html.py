"""Main-text extraction with a tree-structured graphical model.

Each element of a page's DOM is a binary variable, content or boilerplate.
Its own evidence is a logistic score of its features (kind of tag, words in
class, id and role, text length, link density, punctuation); a parent-child
potential says how the label passes from parent to child for that kind of
element.  The model is a tree, so one sum-product pass from the leaves to the
root and one back give the exact marginal of every element.  Text whose element
has a content marginal of at least 0.5 is kept.

Mark-up decides before length does: an element inside one that the mark-up calls
boilerplate (``in_boiler``: a footer, aside, form, comment section, advert ..., at any
depth) has that as its own evidence, stronger than any text it may hold, whose length
and punctuation count up to a limit.  Wrappers of the page (html, body, whatever holds
the article or, without one, a form around the title) are no such element.  Links count
against text outside of an article only.

Weights and potentials are trained on labelled pages: at most
``MAX_FIT_PAGES`` pages (smallest hashes) whose own markup states the labels --
an ``article`` or ``main`` element and the boilerplate elements in and around
it -- once as they are and once with that mark-up's features hidden, so the
model also works on pages without it.  Prior means keep the evidence of words
that the sample happens not to show, and training never weakens what mark-up says
against an element; without labelled pages the priors are the model.

Each page is worked on alone in the tasks and whole; the messages of all pages
of a batch are passed together, level by level, without recursion.

Text: character references are decoded, white space inside a block becomes one
space, blocks are joined by one space in page order; block elements and ``br``
end a block.  Scripts, styles, templates, comments and the head have no text.

Defined results: null or empty html gives an empty text; broken, unclosed or
truncated markup is closed by the usual rules; a page without any element is
one block of content; repeated rows are extracted each; null ids and urls are
kept; other columns are ignored.  Pages of any length are read whole; an element with
even odds is kept; an empty table gives an empty one.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.llm.common import ship

MAX_FIT_PAGES = 400
EDGE_CAP = 2.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']+|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|aria-label|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?",
                   re.I)

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg math iframe object canvas "
             "audio video map datalist".split())
RAW = set("script style title textarea iframe noscript".split())
BOILER = set("nav footer aside form menu dialog button select textarea label fieldset".split())
MAIN = set("article main".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th li summary".split())
BOX = set("html body div section ul ol dl table tbody thead tfoot tr figure details center "
          "address hgroup caption".split())
BLOCK = BOILER | MAIN | TEXT | BOX | {"header", "hr", "br", "option"}
CLOSES_P = (BLOCK - {"br", "button", "label", "select", "textarea", "option", "td", "th"})
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"},
               "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
SCOPE = set("html body div section article main table ul ol dl nav aside footer header form td th "
            "tr blockquote".split())

# Words in class, id and role.
BAD_WORDS = re.compile(
    r"(?:^|[\s_-])(nav\w*|menu\w*|breadcrumbs?|foot(?:er|note)?|header|masthead|side-?bar|aside|ads?|"
    r"advert\w*|promo\w*|sponsor\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"newsletter|subscri\w*|form|login|signup|search|share|sharing|social|related|recommend\w*|"
    r"comments?|commentlist|repl(?:y|ies)|disqus|widget|pagination|pager|toolbar|skip\w*|"
    r"complementary|contentinfo|navigation)(?=$|[\s_-])", re.I)
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(article|post|entry|content|story|main|body|text)(?=$|[\s_-])",
                        re.I)

#: The word that also names the head of an article.
HEAD_WORD = re.compile(r"header", re.I)

KINDS = ["boiler", "header", "main", "text", "box", "inline"]
FEATURES = [*KINDS, "bad_words", "good_words", "hidden", "own_text", "all_text", "link_share",
            "stops", "in_main", "heading", "bias", "in_boiler"]
#: Mark-up that speaks against an element; training does not weaken it.
AGAINST = ["boiler", "bad_words", "hidden", "in_boiler"]
#: Most that the length of the own text and its punctuation count.
TEXT_LIMIT, STOPS_LIMIT = 2.0, 2.0
#: Prior means of the weights; the labelled pages move them.
PRIOR = dict(boiler=-7.0, header=-2.0, main=2.5, text=0.5, box=0.0, inline=0.0, bad_words=-7.0,
             good_words=1.0, hidden=-7.0, own_text=0.3, all_text=0.1, link_share=-2.5, stops=0.2,
             in_main=1.5, heading=0.5, bias=-0.3, in_boiler=-7.0)
#: Prior parent-child counts: how often a child has its parent's label.
PRIOR_COUNTS = {"boiler": ((40, 1), (30, 2)), "header": ((20, 1), (8, 8)), "main": ((6, 6), (1, 20)),
                "text": ((40, 2), (2, 40)), "box": ((20, 8), (3, 20)), "inline": ((60, 1), (1, 60))}


def kind_of(tag: str) -> int:
    if tag in BOILER:
        return 0
    if tag == "header":
        return 1
    if tag in MAIN:
        return 2
    if tag in TEXT:
        return 3
    return 4 if tag in BOX else 5


class Page:
    """Elements (tag, parent, features' parts) and text runs of a page."""
    __slots__ = ("tags", "parent", "bad", "good", "hidden", "head", "runs")

    def __init__(self, source: str):
        self.tags, self.parent = ["#page"], [-1]
        self.bad, self.good, self.hidden, self.head = [0], [0], [0], [0]
        self.runs: list[tuple[int, str | None]] = []      # (element, text or None: block border)
        self._parse(source)

    def _open(self, tag: str, parent: int, attrs: str) -> int:
        bad = good = hidden = head = 0
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true" \
                        or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    hidden = 1
                elif name in ("class", "id", "role", "aria-label"):
                    bad |= bool(BAD_WORDS.search(value))
                    # nothing but "header" speaks against it
                    head |= bad and not BAD_WORDS.search(HEAD_WORD.sub("", value))
                    good |= bool(GOOD_WORDS.search(value))
        self.tags.append(tag)
        self.parent.append(parent)
        self.bad.append(int(bad))
        self.good.append(int(good))
        self.hidden.append(hidden)
        self.head.append(int(head))
        return len(self.tags) - 1

    def _parse(self, s: str) -> None:
        stack, at, silent, n = [0], 0, 0, len(s)
        opened: dict[str, int] = {}

        def pop() -> None:
            nonlocal silent
            tag = self.tags[stack.pop()]
            opened[tag] -= 1
            silent -= tag in SILENT

        def close_to(tags: set) -> None:
            """Close the nearest open element of ``tags``, if it is in scope."""
            for i in range(len(stack) - 1, 0, -1):
                t = self.tags[stack[i]]
                if t in tags:
                    while len(stack) > i:
                        pop()
                    return
                if t in SCOPE:
                    return

        while at < n:
            m = _TOKEN.search(s, at)
            if m is None:
                self._text(stack[-1], s[at:], silent)
                return
            if m.start() > at:
                self._text(stack[-1], s[at:m.start()], silent)
            at = m.end()
            if not m.group(2):
                if m.group().startswith("<![CDATA["):
                    self._text(stack[-1], m.group()[9:].removesuffix("]]>"), silent)
                continue
            tag = m.group(2).lower()
            if m.group(1):                                    # end tag
                if opened.get(tag):
                    while self.tags[stack[-1]] != tag:
                        pop()
                    pop()
                if tag in BLOCK and not silent:
                    self.runs.append((stack[-1], None))
                continue
            if tag in CLOSES_P and opened.get("p"):
                close_to({"p"})
            if tag in SAME_CLOSES and any(opened.get(t) for t in SAME_CLOSES[tag]):
                close_to(SAME_CLOSES[tag])
            if tag == "body" and opened.get("head"):
                close_to({"head"})
            if tag in BLOCK and not silent:
                self.runs.append((stack[-1], None))
            attrs = m.group(3)
            if tag in VOID:
                continue
            k = self._open(tag, stack[-1], attrs)
            if attrs.endswith("/") and tag in ("svg", "math", "path"):
                continue
            stack.append(k)
            opened[tag] = opened.get(tag, 0) + 1
            silent += tag in SILENT
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(s, at)
                if end is None:
                    end_at, after = n, n
                else:
                    end_at, after = end.span()
                if tag == "textarea":
                    self._text(k, s[at:end_at], silent)
                pop()
                at = after

    def _text(self, element: int, text: str, silent: int) -> None:
        if not silent and text:
            self.runs.append((element, _html.unescape(text) if "&" in text else text))

    def blocks(self, keep: np.ndarray) -> str:
        out, now = [], []
        for e, text in self.runs:
            if text is None:
                if now:
                    out.append("".join(now))
                    now = []
            elif keep[e]:
                now.append(text)
        if now:
            out.append("".join(now))
        return " ".join(x for x in (" ".join(b.split()) for b in out) if x)


@dataclass
class Forest:
    """The elements of several pages with their features."""
    first: np.ndarray          # first element of each page
    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    x: np.ndarray
    in_main: np.ndarray
    in_boiler: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tags) for p in pages], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    parent = np.concatenate([np.array(p.parent) + f * (np.array(p.parent) >= 0)
                             for p, f in zip(pages, first)]) if pages else np.zeros(0, np.int64)
    tags = [t for p in pages for t in p.tags]
    kind = np.array([kind_of(t) for t in tags], np.int64)
    own, stops = np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first):
        for e, text in p.runs:
            if text is not None:
                own[f + e] += len(text.strip())
                stops[f + e] += text.count(".") + text.count(",") + text.count("?")
    depth = np.zeros(n, np.int64)
    in_main = np.zeros(n, bool)
    is_main, is_link = kind == 2, np.array([t == "a" for t in tags], bool)
    # parents come before their children
    order_parent = parent.tolist()
    d, im = depth.tolist(), in_main.tolist()
    mains = is_main.tolist()
    for i, q in enumerate(order_parent):
        if q >= 0:
            d[i] = d[q] + 1
            im[i] = im[q] or mains[i]
    depth, in_main = np.array(d, np.int64), np.array(im, bool)
    marks = {name: np.array([v for p in pages for v in getattr(p, name)], bool) for name in ("bad", "good", "hidden", "head")}
    # wrappers: html, body, and what holds an article or, without one, a title
    holds, titled = is_main.copy(), np.array([t == "h1" for t in tags], bool)
    for i in range(n - 1, -1, -1):
        if order_parent[i] >= 0:
            holds[order_parent[i]] |= holds[i]
            titled[order_parent[i]] |= titled[i]
    for a, b in zip(first[:-1], first[1:]):
        if is_main[a:b].any():
            titled[a:b] = False
    wrapper = holds | titled & np.array([t == "form" for t in tags], bool) \
        | np.array([t in ("html", "body", "#page") for t in tags], bool)
    # "header" alone, in an article or beside a good word, is the head of the article
    own_head = in_main | marks["good"]
    called = (kind == 0) | (kind == 1) & ~own_head | marks["bad"] & ~(marks["head"] & own_head) | marks["hidden"]
    called &= ~wrapper
    inside = called.tolist()
    for i, q in enumerate(order_parent):
        if q >= 0 and inside[q]:
            inside[i] = True
    in_boiler = np.array(inside, bool)
    total, linked = own.copy(), np.where(is_link, own, 0.0)
    inner = own.copy()
    by_depth = np.argsort(depth, kind="stable")
    border = np.searchsorted(depth[by_depth], np.arange((int(depth.max()) if n else 0) + 2))
    for level in range(len(border) - 2, 0, -1):
        at = by_depth[border[level]:border[level + 1]]
        linked[at] = np.where(is_link[at], total[at], linked[at])
        np.add.at(total, parent[at], total[at])
        np.add.at(linked, parent[at], linked[at])
        soft = at[kind[at] == 5]
        np.add.at(inner, parent[soft], inner[soft])
        np.add.at(stops, parent[soft], stops[soft])
    x = np.zeros((n, len(FEATURES)))
    x[np.arange(n), kind] = 1
    x[:, 6] = marks["bad"] & ~wrapper & ~(marks["head"] & own_head)
    x[:, 7] = marks["good"]
    x[:, 8] = marks["hidden"]
    x[:, 9] = np.minimum(np.log1p(inner) / 3, TEXT_LIMIT)
    x[:, 10] = np.minimum(np.log1p(total) / 3, TEXT_LIMIT)
    x[:, 11] = np.where(in_main, 0.0, linked / np.maximum(total, 1))
    x[:, 12] = np.minimum(np.log1p(stops), STOPS_LIMIT)
    x[:, 13] = in_main
    x[:, 14] = [t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in tags]
    x[:, 15] = 1
    x[:, 16] = in_boiler
    return Forest(first, parent, depth, kind, x, in_main, in_boiler)


@dataclass
class Model:
    weights: np.ndarray        # of the features
    edges: np.ndarray          # (kind, parent label, child label): log potential


def _edges(counts: np.ndarray) -> np.ndarray:
    """P(child | parent, kind) over P(child | kind): what the parent adds to the
    child's own evidence, at most ``EDGE_CAP`` log units."""
    given = counts / counts.sum(axis=2, keepdims=True)
    alone = counts.sum(axis=1) / counts.sum(axis=(1, 2))[:, None]
    return np.clip(np.log(given) - np.log(alone)[:, None, :], -EDGE_CAP, EDGE_CAP)


def prior_model() -> Model:
    return Model(np.array([PRIOR[f] for f in FEATURES]),
                 _edges(np.array([PRIOR_COUNTS[k] for k in KINDS], float)))


def labels_of(f: Forest) -> np.ndarray:
    """Labels that the markup states: 1 in article or main, 0 elsewhere and in
    boilerplate elements; nan for pages without article or main."""
    y = f.in_main.astype(float)
    y[f.in_boiler] = 0
    for a, b in zip(f.first[:-1], f.first[1:]):
        if not f.in_main[a:b].any():
            y[a:b] = np.nan
    return y


def train(sources: list[str]) -> Model:
    """Weights by ridge logistic regression around the prior means (Newton
    steps), potentials by counts on top of the prior counts."""
    model = prior_model()
    f = forest([Page(s) for s in sources])
    y = labels_of(f) if len(f.parent) else np.zeros(0)
    on = np.flatnonzero(~np.isnan(y))
    if not len(on):
        return model
    hidden = f.x[on].copy()
    hidden[:, [FEATURES.index("in_main"), FEATURES.index("main")]] = 0
    x, t = np.concatenate([f.x[on], hidden]), np.concatenate([y[on], y[on]])
    w, prior = model.weights.copy(), model.weights
    ridge = max(0.01, 200 / len(t))         # few labelled elements move the priors little
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) / len(t) + ridge * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(t) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    firm = [FEATURES.index(c) for c in AGAINST]
    w[firm] = np.minimum(w[firm], prior[firm])
    counts = np.array([PRIOR_COUNTS[k] for k in KINDS], float)
    child = on[f.parent[on] >= 0]
    np.add.at(counts, (f.kind[child], y[f.parent[child]].astype(int), y[child].astype(int)), 1)
    return Model(w, _edges(counts))


def marginals(f: Forest, model: Model) -> np.ndarray:
    """P(content) of every element by sum-product, upward and downward."""
    score = f.x @ model.weights
    belief = np.stack([np.zeros(len(score)), score], axis=1)      # evidence and child messages
    if not len(score):
        return score
    psi = model.edges[f.kind]                                       # (n, parent, child)
    up = np.zeros_like(belief)
    by_depth = np.argsort(f.depth, kind="stable")
    border = np.searchsorted(f.depth[by_depth], np.arange(int(f.depth.max()) + 2))
    for level in range(len(border) - 2, 0, -1):
        at = by_depth[border[level]:border[level + 1]]
        up[at] = np.logaddexp(psi[at, :, 0] + belief[at, :1], psi[at, :, 1] + belief[at, 1:])
        np.add.at(belief, f.parent[at], up[at])
    for level in range(1, len(border) - 1):
        at = by_depth[border[level]:border[level + 1]]
        rest = belief[f.parent[at]] - up[at]                        # without the child's own message
        belief[at] += np.logaddexp(psi[at, 0, :] + rest[:, :1], psi[at, 1, :] + rest[:, 1:])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -30, 30)))


def extract(sources: list[str | None], model: Model) -> list[str]:
    pages = [Page(s or "") for s in sources]
    f = forest(pages)
    p = marginals(f, model)
    out = []
    for page, a, b in zip(pages, f.first[:-1], f.first[1:]):
        keep = p[a:b] >= 0.5
        if b - a == 1:
            keep[:] = True
        out.append(page.blocks(keep))
    return out


_BATCH_CHARS = 1 << 20


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html",
                  max_fit_pages: int = MAX_FIT_PAGES) -> DataFrame:
    """One row per page: ``id, url, text``."""
    ship(pages.sparkSession)
    marked = F.col(html_col).rlike("(?i)<(article|main)[ >]")
    hashed = pages.filter(marked).select(F.col(html_col).alias("h")).withColumn("k", F.xxhash64("h"))
    # only hashes are sorted; then the pages up to the last of them are read
    last = hashed.select("k").distinct().orderBy("k").limit(max_fit_pages).agg(F.max("k")).first()[0]
    sample = (hashed.filter(F.col("k") <= F.lit(last)).dropDuplicates(["k"]).orderBy("k").collect()
              if last is not None else [])
    model = train([r["h"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, out, a = batch.column("html").to_pylist(), [], 0
            while a < len(sources):
                b, size = a, 0
                while b < len(sources) and (b == a or size + len(sources[b] or "") <= _BATCH_CHARS):
                    size += len(sources[b] or "")
                    b += 1
                out.extend(extract(sources[a:b], model))
                a = b
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(out, pa.string())],
                names=["id", "url", "text"])

    return pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "id bigint, url string, text string")
