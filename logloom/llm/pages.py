"""Main text of HTML pages: content marginals of a tree-structured graphical model over the DOM."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the fit reads at most, those with the smallest hash of their address and text.
FIT_PAGES = 300
#: Layouts made of each of them.
LAYOUTS = 6

# Elements of HTML by their role for text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "title", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "button", "textarea",
          "canvas", "audio", "video"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
          "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
          "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
# Words in class and id names of the layouts that the fit makes.
CONTENT_NAMES = ["content", "article", "post", "entry", "story", "body", "main", "text", "page", "blog", "single", "news"]
OTHER_NAMES = ["nav", "navbar", "menu", "header", "masthead", "banner", "footer", "foot", "copyright", "sidebar", "side", "aside",
               "widget", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent",
               "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "search", "form",
               "comment", "comments", "reply", "replies", "discussion", "disqus", "share", "sharing", "social", "related",
               "recommended", "popular", "trending", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "toolbar",
               "skip", "hidden", "gdpr", "privacy", "legal", "disclaimer", "paywall"]

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    names: list[str]
    label: int | None = None
    chars: int = 0
    linked: int = 0
    silent: bool = False


class Tree(HTMLParser):
    """Elements of a page in document order (parents first), and its text events: (node, text, in a
    link), with node -1 where a block begins or ends. Inline elements without names belong to the
    element around them. Unclosed and stray tags are tolerated. Text inside SILENT elements and
    hidden ones is left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, [])]
        self.stack = [("#root", 0, False)]
        self.events: list[tuple[int, str, bool]] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.events.append((-1, "", False))
            self._close_open({"p"}, BLOCKS - {"p"})
        if tag in CLOSED_BY:
            self._close_open(CLOSED_BY[tag], {"ul", "ol", "dl", "table"} | ({"tr"} if tag in ("td", "th") else set()))
        _, node, link = self.stack[-1]
        if tag == "br":
            self.events.append((node, " ", False))
        if tag in VOID:
            return
        known = dict(attrs)
        names = [n.lower() for a in ("class", "id", "role") for n in _NAME.findall(known.get(a) or "")]
        silent = tag in SILENT or "hidden" in known or known.get("aria-hidden") == "true"
        if tag in BLOCKS or names or silent:
            label = known.get("data-label")
            self.nodes.append(Node(tag, node, names, int(label) if label in ("0", "1") else None,
                                   silent=silent or self.nodes[node].silent))
            node = len(self.nodes) - 1
        self.stack.append((tag, node, link or tag == "a"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_open(self, tags: set[str], limits: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                del self.stack[k:]
                return
            if tag in limits:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.events.append((-1, "", False))
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data: str) -> None:
        _, node, link = self.stack[-1]
        if not self.nodes[node].silent:
            self.events.append((node, data, link))


def features(tree: Tree) -> list[list[str]]:
    """What is seen of each element besides its tag, which the edge potentials hold: the words in its
    names, how much text it holds itself, and how much of that is links."""
    nodes = tree.nodes
    for node, text, link in tree.events:
        if node >= 0:
            n = len(text.strip())
            nodes[node].chars += n
            nodes[node].linked += n if link else 0
    out = []
    for node in nodes:
        own = []
        if node.chars:
            own = [f"links {min(3, int(4 * node.linked / node.chars))}", f"size {min(5, int(math.log10(node.chars + 1) * 2))}"]
        out.append(own + [f"name {n}" for n in dict.fromkeys(node.names)])
    return out


@dataclass
class Model:
    """Log-odds of features (content against other), log potentials [parent][child] by the tags of
    both, by that of the child, and for any tags, and those of the root."""

    odds: dict[str, float] = field(default_factory=dict)
    edges: dict[tuple[str, str], list[list[float]]] = field(default_factory=dict)
    root: list[float] = field(default_factory=lambda: [0.0, 0.0])

    def edge(self, parent: str, child: str) -> list[list[float]]:
        return self.edges.get((parent, child)) or self.edges.get(("", child)) or self.edges[("", "")]


def marginals(tree: Tree, model: Model) -> list[float]:
    """Probability of each element to be content, by sum-product messages: from the leaves up to the
    root, then back down. Elements stand after their parents, so both passes are plain loops."""
    nodes = tree.nodes
    own = [(0.0, sum(model.odds.get(f, 0.0) for f in fs)) for fs in features(tree)]
    edges = [model.edge(nodes[n.parent].tag, n.tag) if n.parent >= 0 else [] for n in nodes]

    def plus(a: float, b: float) -> float:
        return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))

    below = [list(x) for x in own]  # evidence of the element and all below it
    sent = [(0.0, 0.0)] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        (b0, b1), e = below[i], edges[i]
        up = plus(e[0][0] + b0, e[0][1] + b1), plus(e[1][0] + b0, e[1][1] + b1)
        sent[i] = up
        above = below[nodes[i].parent]
        above[0] += up[0]
        above[1] += up[1]
    out = [0.0] * len(nodes)
    belief: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
    belief[0] = (below[0][0] + model.root[0], below[0][1] + model.root[1])
    for i in range(1, len(nodes)):
        p0, p1 = belief[nodes[i].parent]
        (u0, u1), e = sent[i], edges[i]
        p0, p1 = p0 - u0, p1 - u1  # the parent without what this child told it
        d0, d1 = plus(p0 + e[0][0], p1 + e[1][0]), plus(p0 + e[0][1], p1 + e[1][1])
        belief[i] = (below[i][0] + d0, below[i][1] + d1)
    for i, (b0, b1) in enumerate(belief):
        out[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, b0 - b1))))
    return out


def main_text(html: str | None, model: Model) -> str:
    """Blocks of content text in page order, joined by an empty line; empty if there is none."""
    tree = Tree(html or "")
    content = [p > 0.5 for p in marginals(tree, model)]
    blocks, held = [], []
    for node, text, _ in [*tree.events, (-1, "", False)]:
        if node >= 0:
            if content[node]:
                held.append(text)
        elif held:
            block = _SPACE.sub(" ", "".join(held)).strip()
            if block:
                blocks.append(block)
            held = []
    return "\n\n".join(blocks)


def labelled_layouts(html: str, rng: random.Random) -> Iterator[str]:
    """Labelled pages made of one page that marks its article: data-label on an element holds for
    what is below it. The page as it is, and layouts that set its paragraphs into other elements
    and names, among menus, notices, adverts, forms and comments whose words come from the page."""
    found = re.search(r"<(article|main)\b[^>]*>(.*?)(</\1\s*>|$)", html, re.DOTALL | re.IGNORECASE)
    if not found:
        return
    yield html[:found.start()] + f"<{found[1]} data-label=1>" + html[found.start(2):]
    blocks = [b for b in (re.sub(r"<[^>]*>", " ", x).strip() for x in re.split(r"</?p\b[^>]*>|</h1>", found[2])) if b]
    if not blocks:
        return

    def other(depth: int = 0) -> str:
        name = "".join(rng.choice([f' class="{n}"', f' id="{n}"', f' class="{n}-{rng.choice(["box", "wrap", "area", "list", "inner"])}"'])
                       for n in [rng.choice(OTHER_NAMES)])
        words = [w for b in rng.sample(blocks, min(2, len(blocks))) for w in b.split()][:rng.randint(3, 60)] or ["x"]
        link = "".join(f'<li><a href="#">{w}</a></li>' for w in words[:8])
        text = " ".join(words)
        tag = rng.choice(["div", "div", "section", "aside", "nav", "footer", "header", "form", "ul"])
        inside = rng.choice([f"<ul>{link}</ul>", f"<p>{text}</p>", text, f"<h3>{words[0]}</h3><p>{text}</p>", f"<div><p>{text}</p></div>",
                             f'<p>{text}</p><p>{text} <a href="#">{words[0]}</a></p>'])
        if tag in ("nav", "footer", "aside", "form") and rng.random() < 0.6:
            name = ""
        if tag in ("header", "section", "ul") and depth:
            tag = "div"
        return f"<{tag}{name} data-label=0>{inside}</{tag}>"

    for _ in range(LAYOUTS):
        title, *rest = blocks
        paragraphs = []
        for b in rest:
            tag = rng.choice(["p"] * 8 + ["blockquote", "h2", "li", "div", "pre"])
            if rng.random() < 0.2:
                w = b.split()
                b = f'{" ".join(w[:-1])} <a href="#">{w[-1]}</a>'
            b = f"<ul><li>{b}</li></ul>" if tag == "li" else f"<{tag}>{b}</{tag}>"
            paragraphs.append(b)
            if rng.random() < 0.06:
                paragraphs.append(other(1))
        heading = f"<h1>{title}</h1>"
        if rng.random() < 0.3:
            heading = f"<header>{heading}</header>"
        body = heading + "".join(paragraphs)
        if rng.random() < 0.4:
            body += other(1)
        name = rng.choice(CONTENT_NAMES)
        tag = rng.choice(["article", "article", "main", "div", "section"])
        mark = f' {rng.choice(["class", "id"])}="{name}{rng.choice(["", "-body", "-content", "-text"])}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
        if rng.random() < 0.08:  # no element around the article
            body = re.sub(r"^<(\w+)|(?<=>)<(p|pre|h1|h2|ul|blockquote)(?=>)", lambda m: f"{m[0]} data-label=1", body)
        else:
            body = f"<{tag}{mark} data-label=1>{body}</{tag}>"
        if rng.random() < 0.4:
            body = f'<div class="{rng.choice(["container", "wrapper", "row", "layout", "site", "grid"])}">{body}{other()}</div>'
        yield ("<html><head><title>t</title></head><body>" + "".join(other() for _ in range(rng.randint(1, 4))) + body
               + "".join(other() for _ in range(rng.randint(1, 4))) + "</body></html>")


def fit_trees(trees: list[Tree], prior: float = 0.5) -> Model:
    """Counts over labelled trees with an even prior; an element without a label of its own has that
    of its parent, the root is other."""
    seen, total = [Counter(), Counter()], [0, 0]
    pairs: dict[tuple[str, str], np.ndarray] = {}
    for tree in trees:
        labels: list[int] = []
        for node, fs in zip(tree.nodes, features(tree)):
            y = node.label if node.label is not None else labels[node.parent] if node.parent >= 0 else 0
            labels.append(y)
            if node.parent >= 0:
                for key in ((tree.nodes[node.parent].tag, node.tag), ("", node.tag), ("", "")):
                    pairs.setdefault(key, np.zeros((2, 2)))[labels[node.parent], y] += 1
            total[y] += 1
            seen[y].update(fs)
    odds = {f: math.log((seen[1][f] + prior) / (total[1] + 2 * prior)) - math.log((seen[0][f] + prior) / (total[0] + 2 * prior))
            for f in {*seen[0], *seen[1]}}
    edges: dict[tuple[str, str], list[list[float]]] = {}
    base = np.full((2, 2), 0.5)
    for key in sorted(pairs, key=lambda k: (bool(k[0]), bool(k[1]), k)):  # each shrinks towards the next more general one
        above = np.exp(edges[("", key[1])] if key[0] else edges[("", "")]) if key != ("", "") else base
        own = pairs[key] + 2 * prior * above
        edges[key] = np.log(own / own.sum(axis=1, keepdims=True)).tolist()
    return Model(odds, edges, [math.log(0.999), math.log(0.001)])


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, url_col: str = "url", html_col: str = "html") -> Model:
    """Learns from a bounded sample of pages that mark their article, and layouts made of them."""
    marked = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)\b") & (F.length(html_col) < 200_000))
    rows = marked.select(F.col(html_col).alias("html"), F.xxhash64(url_col, html_col).alias("h")).orderBy("h", "html").limit(fit_pages)
    trees = []
    for r in rows.toLocalIterator():
        trees += [Tree(x) for x in labelled_layouts(r["html"], random.Random(r["h"]))]
    return fit_trees(trees) if trees else fit_trees([Tree("<body><article data-label=1><p>a</p></article><nav>b</nav></body>")])


def extract(pages: DataFrame, model: Model, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The pages with the main text of each whole page in `text_col` (replaced where the input has
    it). A null or empty page, and one without content, gives an empty text. Rows are independent."""
    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, model) for h in pages], dtype=object)

    keep = [c for c in pages.columns if c.lower() != text_col.lower()]
    return pages.select(*[F.col(f"`{c}`") for c in keep], text(F.col(html_col).cast("string")).alias(text_col))
