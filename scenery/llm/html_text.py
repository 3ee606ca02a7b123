"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element is a variable, content or not. A potential of its own comes from what is
seen of it (tag, words in class and id, how much text and how much of it is links,
commas, depth), and a pair potential ties it to its parent: content sits in content.
Sum-product messages go up from the leaves and down from the root, which is exact on a
tree, and give each element's probability of being content given the whole page.

The potentials are counts, smoothed, over labelled pages: MAIN_PAGES of them, written by
a seeded generator (`labelled_pages`) that knows which of its elements are content. No
page is downloaded and no corpus page is used for training.

Defined results: null and empty html give no text; markup that does not parse as
elements is text; unclosed and stray tags are repaired as browsers do for paragraphs,
list items, table parts and headings; raw text of scripts and styles, comments and
declarations never count: a comment that is not closed runs to the page's end, and a
marked section or malformed declaration ends at its first `>`. A page without any
content element gives the empty string. An element as likely content as not is
content; pages of any length and depth are read whole, one at a time; repeated rows are
read alike; an input column named text or n_chars is replaced, others are returned as
they are; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN_PAGES = 400
SEED = 11
CONTENT, OTHER = 1, 0

# HTML's void, raw-text, hidden, inline and self-closing elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select option button".split())
HIDDEN = RAW | frozenset("head title nav header footer aside form dialog menu".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset({"p"}),
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}),
}
SCOPES = frozenset("html body article section main div table ul ol dl td th tr aside nav header footer form blockquote figure".split())
BLOCKS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Words of class and id that speak for one kind of element.
GOOD_WORDS = frozenset("article content main body post entry story text prose page read".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright sidebar side aside related "
    "widget share social comment comments reply replies disqus notice cookie cookies consent gdpr modal popup newsletter subscribe signup login form search tags pagination pager skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


class Node:
    __slots__ = ("tag", "marks", "parent", "children", "words", "links", "commas", "depth")

    def __init__(self, tag: str, marks: int, parent: Node | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.children: list[Node | str] = []
        self.words = self.links = self.commas = 0
        self.depth = 0 if parent is None else parent.depth + 1


def _marks(attrs: list[tuple[str, str | None]]) -> int:
    """-1 for words that speak against content, 1 for those that speak for it, else 0."""
    good = False
    for name, value in attrs:
        if name in ("class", "id", "role", "hidden", "aria-hidden"):
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
                return -1
            words = re.split(r"[^a-z0-9]+", (value or "").lower())
            if any(w in BAD_WORDS for w in words):
                return -1
            good = good or any(w in GOOD_WORDS for w in words)
    return int(good)


class _Builder(HTMLParser):
    """Builds the tree, repairing what is left open; without recursion, so depth has no bound."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", 0, None)
        self.bold: list[str] = []

    def _close(self, tags: frozenset[str]) -> None:
        node = self.now
        while node.parent is not None and (node.tag in tags or node.tag in INLINE):
            if node.tag in tags:
                self.now = node.parent
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS_P:
            self._close(CLOSES["p"])
        if tag in CLOSES:
            self._close(CLOSES[tag])
        if tag == "body":
            while self.now.tag in HIDDEN and self.now.parent is not None:
                self.now = self.now.parent
        node = Node(tag, _marks(attrs) if attrs else 0, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.now
        while node is not None and node.tag != tag:
            if node.tag in SCOPES and tag in INLINE:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.now = node.parent

    def handle_data(self, data: str) -> None:
        if data:
            self.now.children.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def in_order(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def measure(nodes: list[Node]) -> None:
    """Words, words in links and commas of each element with all below it."""
    for node in reversed(nodes):
        if node.tag in RAW:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.words += len(c.split())
                node.commas += c.count(",")
            else:
                node.words += c.words
                node.links += c.words if c.tag == "a" else c.links
                node.commas += c.commas


def _size(n: int) -> int:
    return 0 if n == 0 else min(5, 1 + int(math.log(n, 4)))


def features(node: Node) -> tuple[str, ...]:
    """What is seen of an element, as values that are counted."""
    tag = node.tag if node.tag in KNOWN else "?"
    share = node.links / node.words if node.words else 0.0
    links = 0 if share == 0 else 1 if share < 0.35 else 2 if share < 0.8 else 3
    return (
        f"tag={tag}, marks={node.marks}",
        f"tag={tag}, links={links}",
        f"marks={node.marks}",
        f"words={_size(node.words)}",
        f"commas={min(3, node.commas)}",
        f"depth={min(6, node.depth)}",
    )


KNOWN = HIDDEN | SCOPES | BLOCKS_P | INLINE | VOID | frozenset("main section caption thead tbody tfoot figcaption pre".split())


class TreeModel:
    """Log potentials: of an element's label given what is seen, and of a label given the parent's."""

    def __init__(self, pages: list[tuple[Node, dict[int, int]]]):
        seen: list[Counter] = [Counter(), Counter()]
        pairs, total = Counter(), [0, 0]
        values: set[str] = set()
        for root, labels in pages:
            nodes = in_order(root)
            measure(nodes)
            for node in nodes:
                y = labels[id(node)]
                total[y] += 1
                own = features(node)
                seen[y].update(own)
                values.update(own)
                if node.parent is not None:
                    pairs[labels[id(node.parent)], y] += 1
        self.own = {v: tuple(math.log((seen[y][v] + 0.5) / (total[y] + 1.0)) for y in (0, 1)) for v in values}
        self.unseen = tuple(math.log(0.5 / (total[y] + 1.0)) for y in (0, 1))
        # A child's label given its parent's, over the label's own frequency, which the element's potential holds already.
        self.pair = [[(pairs[p, y] + 0.5) / (pairs[p, 0] + pairs[p, 1] + 1.0) / ((total[y] + 0.5) / (sum(total) + 1.0)) for y in (0, 1)] for p in (0, 1)]
        self.prior = [math.log((total[y] + 0.5) / (sum(total) + 1.0)) for y in (0, 1)]
        self.cache: dict[tuple[str, ...], tuple[float, float]] = {}

    def potential(self, node: Node) -> tuple[float, float]:
        own = features(node)
        if own not in self.cache:
            logs = [self.prior[y] + sum(self.own.get(v, self.unseen)[y] for v in own) for y in (0, 1)]
            top = max(logs)
            self.cache[own] = (math.exp(logs[0] - top), math.exp(logs[1] - top))
        return self.cache[own]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Each element's probability of being content, by messages up the tree and down again."""
        place = {id(n): i for i, n in enumerate(nodes)}
        below = [list(self.potential(n)) for n in nodes]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        pair = self.pair
        for i in range(len(nodes) - 1, 0, -1):
            b0, b1 = below[i]
            m0, m1 = pair[0][0] * b0 + pair[0][1] * b1, pair[1][0] * b0 + pair[1][1] * b1
            s = m0 + m1
            up[i] = (m0 / s, m1 / s)
            at = below[place[id(nodes[i].parent)]]
            at[0] *= up[i][0]
            at[1] *= up[i][1]
            s = at[0] + at[1]
            at[0], at[1] = at[0] / s, at[1] / s
        out = [0.0] * len(nodes)
        down: list[tuple[float, float]] = [(1.0, 1.0)] * len(nodes)
        for i, node in enumerate(nodes):
            d0, d1 = down[i]
            f0, f1 = below[i][0] * d0, below[i][1] * d1
            out[i] = f1 / (f0 + f1)
            for c in node.children:
                if not isinstance(c, str):
                    j = place[id(c)]
                    g0, g1 = f0 / max(up[j][0], 1e-300), f1 / max(up[j][1], 1e-300)
                    m0, m1 = g0 * pair[0][0] + g1 * pair[1][0], g0 * pair[0][1] + g1 * pair[1][1]
                    s = m0 + m1
                    down[j] = (m0 / s, m1 / s)
        return out


# Names the generator gives to its elements, as sites write them; what is seen of them goes by the words above.
LAYOUT = {
    "nav": "site-nav main-menu topnav nav-primary breadcrumbs pagination-links",
    "head": "page-header masthead site-banner top-bar headline-bar",
    "foot": "site-footer footer-links colophon copyright legal-line",
    "side": "sidebar-right related-posts widget-area secondary share-buttons tag-cloud",
    "ad": "ad-slot advert sponsored-box promo-banner cookie-notice newsletter-signup overlay",
    "comments": "comments-area comment-list reader-comments disqus_thread replies responses",
    "form": "search-box login-form subscribe contact-us",
    "main": "post-content entry article-body main-column story-text content page-content prose blog",
}


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) + ("," if rng.random() < 0.08 else "") for _ in range(n)]
    return " ".join(out).capitalize() + "."


def labelled_pages(n: int = MAIN_PAGES, seed: int = SEED) -> Iterator[tuple[str, set[str]]]:
    """Pages of many layouts; the elements with data-content are the content ones."""
    rng = random.Random(seed)

    def text(low: int, high: int) -> str:
        return _words(rng, rng.randint(low, high))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{text(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def boiler(kind: str) -> str:
        name = rng.choice(LAYOUT[kind].split()) if rng.random() < 0.85 else ""
        mark = f' class="{name}"' if name else ""
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside"}.get(kind, "div") if rng.random() < 0.75 else "div"
        if tag == "div" and not name:
            mark = f' id="{rng.choice(LAYOUT[kind].split())}"'
        body = {
            "nav": lambda: links(rng.randint(2, 9)),
            "head": lambda: f"<p>{text(2, 8)}</p>" + links(rng.randint(0, 4)),
            "foot": lambda: rng.choice([text(3, 14), f"<p>{text(3, 14)}</p>" + links(2)]),
            "side": lambda: f"<h3>{text(1, 4)}</h3>" + links(rng.randint(2, 6)),
            "ad": lambda: rng.choice([text(3, 25), f"<p>{text(3, 25)}</p>"]),
            "comments": lambda: f"<{(t := rng.choice(['h2', 'h3', 'h4']))}>{text(1, 3)}</{t}>" + "".join(f"<div><b>{text(1, 2)}</b><p>{text(3, 40)}</p></div>" for _ in range(rng.randint(1, 4))),
            "form": lambda: f"<form><label>{text(1, 3)}</label><input><button>{text(1, 2)}</button></form>",
        }[kind]()
        return f"<{tag}{mark}>{body}</{tag}>"

    def block(style: str) -> str:
        kind = rng.random()
        if style == "short":
            return f"<p data-content>{text(1, 4)}</p>"
        if style == "long":
            return f"<p data-content>{text(100, 900)}</p>"
        inner = lambda s: s if rng.random() < 0.7 else f'<{(t := rng.choice(["b", "em", "i", "strong", "span"]))} data-content>{s}</{t}>'
        if kind < 0.72:
            return f"<p data-content>{inner(text(1, 120))}{'<br data-content>' + text(1, 20) if rng.random() < 0.15 else ''}</p>"
        if kind < 0.8:
            return f"<h2 data-content>{text(1, 8)}</h2>"
        if kind < 0.87:
            return "<ul data-content>" + "".join(f"<li data-content>{text(1, 20)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote data-content><p data-content>{text(5, 50)}</p></blockquote>"
        if kind < 0.95:
            return f'<p data-content>{text(1, 20)} <a href="/x" data-content>{text(1, 3)}</a> {text(1, 30)}</p>'
        if kind < 0.98:
            return "<table data-content>" + "".join(f"<tr data-content><td data-content>{text(1, 4)}</td><td data-content>{text(1, 4)}</td></tr>" for _ in range(2)) + "</table>"
        return f"<pre data-content>{text(4, 30)}</pre>"

    for _ in range(n):
        tag = rng.choice(["article"] * 6 + ["main", "div", "section"])
        mark = f' class="{rng.choice(LAYOUT["main"].split())}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
        style = rng.choice(["mixed"] * 7 + ["short"] * 2 + ["long"])
        title = rng.choice(["h1", "h1", "h2"])
        blocks = [f"<{title} data-content>{text(1, 10)}</{title}>"] * (rng.random() < 0.9) + [block(style) for _ in range(rng.choice([0, 1, 2, 4, 8, 16]) * (4 if style == "short" else 1))]
        for kind in ("ad", "comments", "form", "side"):
            if rng.random() < 0.12:
                blocks.insert(rng.randint(0, len(blocks)), boiler(kind))
        around = [boiler(k) for k in ("head", "nav", "ad", "side") if rng.random() < 0.6]
        after = [boiler(k) for k in ("comments", "form", "side", "ad", "foot") if rng.random() < 0.5]
        main = f"<{tag}{mark} data-content>{''.join(blocks)}</{tag}>"
        if rng.random() < 0.3:
            main = f"<div data-content>{main}</div>"
        yield f"<!DOCTYPE html><html data-content><head><title>{text(1, 9)}</title><style>p{{}}</style><script>var x;</script></head><body data-content>{''.join(around)}{main}{''.join(after)}</body></html>"


class _Labeller(_Builder):
    """Takes the labels off the generator's pages."""

    def __init__(self):
        super().__init__()
        self.labels = {id(self.root): CONTENT}
        self.kept = [self.root]

    def handle_starttag(self, tag, attrs):
        label = any(k == "data-content" for k, _ in attrs)
        before = self.now
        super().handle_starttag(tag, [x for x in attrs if x[0] != "data-content"])
        node = self.now if tag not in VOID else self.now.children[-1]
        self.kept.append(node)
        self.labels[id(node)] = int(label)
        del before


@lru_cache(maxsize=4)
def trained(n: int = MAIN_PAGES, seed: int = SEED) -> TreeModel:
    pages, alive = [], []
    for html in labelled_pages(n, seed):
        p = _Labeller()
        p.feed(html)
        p.close()
        alive.append(p.kept)
        pages.append((p.root, p.labels))
    return TreeModel(pages)


SPACE_RUN = re.compile(r"\s+")


def main_text(html: str | None, model: TreeModel) -> str:
    """The blocks of the content elements in page order, joined by one space."""
    if not html:
        return ""
    root = parse(html)
    nodes = in_order(root)
    measure(nodes)
    content = dict(zip(map(id, nodes), model.marginals(nodes), strict=True))
    blocks: list[str] = []
    now: list[str] = []

    def end() -> None:
        found = SPACE_RUN.sub(" ", "".join(now)).strip()
        if found:
            blocks.append(found)
        now.clear()

    # An element is left out with all below it if it is hidden by kind or more likely not content.
    # A link or other inline element within a block goes with the block, unless its own class speaks against it.
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            now.append(item)
            continue
        block = item.tag not in INLINE
        if closing:
            end()
            continue
        judged = item.tag not in VOID and (block or item.marks < 0 or item.parent is root)
        out = item.tag in HIDDEN or (judged and content[id(item)] < 0.5)
        if block:
            end()
        if out:
            continue
        if block:
            stack.append((item, True))
        stack.extend((c, False) for c in reversed(item.children))
    end()
    return " ".join(blocks)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text, the page's main text, and n_chars, its code points."""
    fields = [f"`{n}` {t}" for n, t in pages.drop("text", "n_chars").dtypes if n != html]
    schema = ", ".join([*fields, "text string", "n_chars long"])

    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x, model.value) for x in batch[html]]
            yield batch.drop(columns=[html]).assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.drop("text", "n_chars").mapInPandas(run, schema)
