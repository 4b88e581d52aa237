"""Main text of HTML pages by a tree-structured graphical model.

A page is parsed into its elements. Those that hold blocks are the nodes of a
tree; each is labelled content or not. A node's own potential is linear in its
features (tag, words in class, id and role, own text, links); the potential of
a parent and a child is a 2x2 table for each kind of edge. Sum-product messages
go from the leaves up and from the root down and give each node's marginal,
level by level for all nodes of a batch of pages at once. Weights are trained
by the gradient of the likelihood, with the same messages, on labelled pages
that a seeded generator lays out in many ways. A page's main text is the own
text of the nodes whose marginal exceeds one half, in page order.

Scripts, styles, comments and other markup have no text. Character references
are decoded; white space inside a block becomes one space. Inline elements belong
to their block, whatever they are called, unless the block has less text than they.

Null or blank html gives an empty text. Every row is judged by itself, so ties and
repeated rows give equal texts, and an empty table gives no rows. Pages are read in
time that grows with their length: a tag that never ends is dropped with what
follows it, and elements deeper than DEPTH become children of the last one above.
"""

from __future__ import annotations

import functools
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Labelled pages that the weights are trained on, their seed, and gradient steps.
TRAIN_PAGES = 600
TRAIN_SEED = 11
STEPS = 250

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of their own for a reader; their bodies are skipped.
RAW = frozenset("script style noscript template iframe svg math canvas object audio video".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
P_ENDERS = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tr td th tbody ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
TAGS = (
    "html head body title div p main article section nav header footer aside form ul ol li dl dt dd table tr td th "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption button select option textarea dialog address details summary fieldset input"
).split()
# Words in class, id and role that speak for a kind of region.
CUES = {
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense outbrain taboola",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toolbar skip toc",
    "header": "header masthead topbar branding logo head",
    "footer": "footer foot copyright contentinfo legal colophon bottom",
    "side": "sidebar side aside complementary widget widgets rail related recommended trending popular more",
    "comment": "comment comments reply replies disqus respond discussion reviews thread",
    "notice": "cookie cookies consent gdpr notice alert alertdialog popup modal overlay dialog toast banner disclaimer announcement warning",
    "share": "share sharing social follow subscribe newsletter signup login signin search form",
    "meta": "byline author date published timestamp tags categories meta",
    "main": "main content article post entry story body text page",
}
_CUE_OF = {w: i for i, words in enumerate(CUES.values()) for w in words.split()}
_TAG_OF = {t: i for i, t in enumerate(TAGS)}
_LOOSE = ("cookie", "advert", "sponsor", "comment", "sidebar", "footer", "navigation", "newsletter", "subscribe")
_LOOSE_CUE = ("notice", "advert", "advert", "comment", "side", "footer", "menu", "share", "share")

N_TAGS, N_CUES = len(TAGS) + 1, len(CUES)
N_NUMBERS = 13
WIDTH = N_TAGS + N_CUES + N_NUMBERS
#: Tags and cues of regions beside the article.
SIDE_COLUMNS = [*(_TAG_OF[t] for t in ("nav", "aside", "footer", "form", "dialog", "head")), *(N_TAGS + i for i, c in enumerate(CUES) if c not in ("main", "meta"))]
MAIN_COLUMNS = [_TAG_OF["article"], _TAG_OF["main"], N_TAGS + list(CUES).index("main")]
#: Kinds of edges: the child is plain, a section of its own, or named by a cue.
SECTIONING = frozenset("nav header footer aside form main article section dialog button select fieldset".split())
KINDS = 3

#: Elements are nested so deep at most.
DEPTH = 400
# Words in names that say nothing of what a region is for.
NEUTRAL = frozenset(
    "box wrap wrapper container inner outer block area section region zone left right top panel item items list links link posts articles stories cards "
    "card group column col row grid layout module component unit slot holder site global primary secondary js is has sticky fixed new mobile desktop "
    "sm md lg xs default standard buttons button icons icon bar strip reader user the one two three".split()
)
TEXT_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre figcaption caption summary".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in (*RAW, "title", "textarea")}


class Tree:
    """Nodes of one page in page order."""

    def __init__(self):
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.tag: list[str] = ["html"]
        self.cues: list[frozenset[int]] = [frozenset()]
        self.hidden: list[bool] = [False]
        #: Text parts in page order: node, text, whether a link holds it.
        self.parts: list[tuple[int, str, bool]] = []

    def add(self, parent: int, tag: str, attrs: str) -> int:
        cues, hidden = _read_attrs(attrs) if attrs else (frozenset(), False)
        if self.depth[parent] >= DEPTH:
            parent = self.parent[parent]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.cues.append(cues)
        self.hidden.append(hidden)
        return len(self.parent) - 1


def _name_cues(name: str) -> set[int]:
    """What one class, id or role says: its last word that is not neutral counts, as in "reader-comments" or
    "acme-footer-box"; "popular-science" is no list of popular pages."""
    words = _WORDS.findall(_HUMP.sub(r"\1-\2", name).lower())
    main = list(CUES).index("main")
    known = {_CUE_OF[w] for w in words if w in _CUE_OF}
    head = next((w for w in reversed(words) if w not in NEUTRAL and _CUE_OF.get(w) != main), None)
    if head is None:
        return known
    if head in _CUE_OF:
        return known
    return {list(CUES).index(c) for w, c in zip(_LOOSE, _LOOSE_CUE, strict=True) if w in head} if len(words) == 1 else set()


def _attrs(attrs: str) -> tuple[frozenset[int], bool]:
    cues, hidden = set(), False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            hidden = True
        elif name in ("class", "id", "role"):
            for x in value.split():
                cues |= _name_cues(x)
    if len(cues) > 1:
        cues.discard(list(CUES).index("main"))  # "sponsored-content", "comment-body": the other word tells
    return frozenset(cues), hidden


_short_attrs = functools.lru_cache(maxsize=20_000)(_attrs)


def _read_attrs(attrs: str) -> tuple[frozenset[int], bool]:
    return _short_attrs(attrs) if len(attrs) < 300 else _attrs(attrs)


def _tokens(page: str):
    """Texts (None, text) and tags (name, (closing, attributes, end)); the reader may send a place to go on from."""
    at, size, quotes = 0, len(page), True
    seek = 0
    while at < size:
        start = page.find("<", max(at, seek))
        tag = start >= 0 and _NAME.match(page, start)
        if start >= 0 and not tag and page[start + 1 : start + 2] not in ("!", "?"):
            seek = start + 1  # a sign, no tag
            continue
        stop = start if start >= 0 else size
        if stop > at:
            yield None, page[at:stop]
        if start < 0:
            return
        if not tag:
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            at = end + len(mark) if end >= 0 else size
            continue
        whole = _TAG.match(page, start) if quotes else None
        if whole:
            at, attrs = whole.end(), whole.group(3)
        else:
            end = page.find(">", tag.end())
            if end < 0:
                return  # a tag that never ends
            quotes = False  # a quote that never ends: from here on the next > ends a tag
            at, attrs = end + 1, page[tag.end() : end]
        to = yield tag.group(2).lower(), (tag.group(1) != "", attrs, at)
        if to is not None:
            at = to
            yield None, ""  # the answer to send()


class Stack:
    """Open elements with their nodes, and how many of each kind are open."""

    def __init__(self):
        self.items: list[tuple[str, int]] = [("html", 0)]
        self.open: dict[str, int] = {"html": 1}

    def push(self, tag: str, node: int) -> None:
        self.items.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1

    def cut(self, k: int) -> None:
        """Elements from the k-th on are closed."""
        for tag, _ in self.items[k:]:
            self.open[tag] -= 1
        del self.items[k:]

    def close(self, tags: frozenset[str] | set[str], fence) -> bool:
        """The innermost open element of these kinds and all in it are closed, if none that fence(tag) names stands before it."""
        if not any(self.open.get(t) for t in tags):
            return False
        for k in range(len(self.items) - 1, 0, -1):
            if self.items[k][0] in tags:
                self.cut(k)
                return True
            if fence(self.items[k][0]):
                return False
        return False


def parse(page: str) -> Tree:
    """The tree of a page; missing and stray end tags are mended as browsers mostly do."""
    tree, stack = Tree(), Stack()
    size = len(page)
    endless: set[str] = set()
    named: list[int] = []
    size_of: dict[int, int] = {}

    def say(node: int, text: str) -> None:
        if text.isspace():
            tree.parts.append((node, " ", False))
        else:
            text = entities.unescape(text) if "&" in text else text
            tree.parts.append((node, text, stack.open.get("a", 0) > 0))
            size_of[node] = size_of.get(node, 0) + len(text.strip())

    reader = _tokens(page)
    for tag, got in reader:
        top = stack.items[-1][1]
        if tag is None:
            if got:
                say(top, got)
            continue
        closing, attrs, at = got
        if closing:
            if tag not in ("html", "body"):
                stack.close({tag}, (lambda t: t not in INLINE) if tag in INLINE else (lambda t: False))
            continue
        if tag in RAW or tag in ("title", "textarea"):
            if (not attrs.endswith("/") or tag in ("script", "style", "title", "textarea")) and tag not in endless:
                end = _RAW_END[tag].search(page, at)
                if not end and tag in RAW and tag not in ("script", "style"):
                    endless.add(tag)
                    continue
                if tag in ("title", "textarea"):
                    say(tree.add(top, tag, attrs), page[at : end.start() if end else size] or " ")
                reader.send(end.end() if end else size)
            continue
        if tag == "html" or (tag == "body" and stack.open.get("body")):
            continue
        if tag in INLINE:
            if tag == "br":
                tree.parts.append((top, " ", False))
            elif tag not in VOID and not attrs.endswith("/"):
                cues, hidden = _read_attrs(attrs) if attrs else (frozenset(), False)
                node = top
                if hidden or (cues and tag != "a" and tree.tag[top] not in TEXT_BLOCKS):  # a named region is judged by itself
                    node = tree.add(top, "div", attrs)
                    if not hidden:
                        named.append(node)
                stack.push(tag, node)
            continue
        if tag in P_ENDERS:
            stack.close({"p"}, lambda t: t not in INLINE)
        if tag in CLOSES:
            closed, fence = CLOSES[tag]
            stack.close(closed, lambda t, fence=fence: t in fence)
        top = stack.items[-1][1]
        if tag in VOID:
            tree.parts.append((top, " ", False))
            continue
        node = tree.add(top, tag, attrs)
        if not attrs.endswith("/"):
            stack.push(tag, node)
    back = {}
    for k in named:  # a named part of a sentence is part of its block
        if size_of.get(tree.parent[k], 0) > size_of.get(k, 0):
            back[k] = back.get(tree.parent[k], tree.parent[k])
            tree.cues[k] = frozenset()
    if back:
        tree.parts = [(back.get(n, n), text, link) for n, text, link in tree.parts]
    return tree


class Forest:
    """The trees of a batch as arrays: parents, levels, features, kinds of edges."""

    def __init__(self, trees: list[Tree]):
        n = [len(t.parent) for t in trees]
        self.first = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        self.parent = np.concatenate([np.array(t.parent) + (a if a else 0) for t, a in zip(trees, self.first.tolist(), strict=False)]) if trees else np.zeros(0, np.int64)
        roots = self.first[:-1]
        self.parent[roots] = -1
        depth = np.array([d for t in trees for d in t.depth], np.int64)
        tag = np.array([_TAG_OF.get(x, N_TAGS - 1) for t in trees for x in t.tag], np.int64)
        total = int(self.first[-1])
        x = np.zeros((total, WIDTH), np.float64)
        x[np.arange(total), tag] = 1
        kind = np.array([1 if y in SECTIONING else 0 for t in trees for y in t.tag], np.int64)
        row, col = [], []
        i = 0
        for t in trees:
            for c in t.cues:
                for k in c:
                    row.append(i)
                    col.append(N_TAGS + k)
                i += 1
        if row:
            x[row, col] = 1
            kind[np.array(row)] = 2
        own, linked, ends = np.zeros(total), np.zeros(total), np.zeros(total)
        for base, t in zip(self.first.tolist(), trees, strict=False):
            for node, text, link in t.parts:
                k = len(text.strip())
                if k:
                    own[base + node] += k
                    linked[base + node] += k * link
                    ends[base + node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        whole, whole_links = own.copy(), linked.copy()
        for nodes in reversed(self.levels):
            np.add.at(whole, self.parent[nodes], whole[nodes])
            np.add.at(whole_links, self.parent[nodes], whole_links[nodes])
        hidden = np.array([h for t in trees for h in t.hidden], float)
        is_main = x[:, MAIN_COLUMNS].any(1)
        is_side = x[:, SIDE_COLUMNS].any(1)
        inside, beside = np.zeros(total, bool), np.zeros(total, bool)
        for nodes in self.levels:
            inside[nodes] = inside[self.parent[nodes]] | is_main[self.parent[nodes]]
            beside[nodes] = beside[self.parent[nodes]] | is_side[self.parent[nodes]]
        has_main = np.repeat(np.add.reduceat(is_main, roots) > 0, n) if total else is_main
        numbers = np.stack(
            [
                np.ones(total), own > 0, np.minimum(np.log1p(own), 8) / 4, np.minimum(np.log1p(whole), 10) / 5, linked / np.maximum(own, 1),
                whole_links / np.maximum(whole, 1), np.minimum(ends, 5) / 5, hidden, (own > 0) & (own < 30), own > 120,
                inside, has_main & ~inside & ~is_main, is_main & ~inside & ~beside & ~is_side,
            ], 1,
        )
        x[:, N_TAGS + N_CUES :] = numbers
        self.x, self.kind = x, kind

    def marginals(self, w: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and P(parent label, child label) of each node's edge to its parent."""
        total = len(self.x)
        unary = np.zeros((total, 2))
        unary[:, 1] = self.x @ w
        up = np.zeros((total, 2))  # from a node to its parent
        belief = unary.copy()
        for nodes in reversed(self.levels):
            z = pair[self.kind[nodes]] + belief[nodes][:, None, :]
            up[nodes] = np.logaddexp(z[:, :, 0], z[:, :, 1])
            np.add.at(belief, self.parent[nodes], up[nodes])
        joint = np.zeros((total, 2, 2))
        for nodes in self.levels:
            p = self.parent[nodes]
            rest = belief[p] - up[nodes]  # what the parent knows without this child
            z = pair[self.kind[nodes]] + rest[:, :, None] + belief[nodes][:, None, :]
            z -= z.max((1, 2), keepdims=True)
            e = np.exp(z)
            joint[nodes] = e / e.sum((1, 2), keepdims=True)
            down = pair[self.kind[nodes]] + rest[:, :, None]
            belief[nodes] += np.logaddexp(down[:, 0, :], down[:, 1, :])
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), joint


def train(trees: list[Tree], labels: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge tables that raise the likelihood of the labels (Adam steps on the exact gradient)."""
    forest = Forest(trees)
    y = np.array([v for page in labels for v in page], np.int64)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    theta = np.zeros(WIDTH + KINDS * 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, pair = theta[:WIDTH], theta[WIDTH:].reshape(KINDS, 2, 2)
        p, joint = forest.marginals(w, pair)
        want = np.zeros((KINDS, 2, 2))
        np.add.at(want, forest.kind[child], joint[child])
        grad = np.concatenate((forest.x.T @ (y - p), (seen - want).reshape(-1))) / len(trees) - 0.0004 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH:].reshape(KINDS, 2, 2)


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> tuple[list[Tree], list[list[int]]]:
    """Seeded pages in many layouts with a label for each node."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p

    def say(lo: int, hi: int, mark: str = "") -> str:
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) for _ in range(int(rng.integers(lo, hi + 1)))]
        text = " ".join(words)
        if mark == ".":
            text = ". ".join(text[i : i + 60].strip().capitalize() for i in range(0, len(text), 60)) + "."
        return text.upper() if chance(0.04) else text

    trees, labels = [], []
    for _ in range(n):
        t = Tree()
        y = [1]
        brief = chance(0.3)  # an article of a few words

        def add(parent: int, tag: str, attrs: str = "", text: str = "", good: int = 0, link: bool = False, t=t, y=y) -> int:
            k = t.add(parent, tag, attrs)
            y.append(good)
            if text:
                t.parts.append((k, text, link))
            return k

        def listing(parent: int, lo: int, hi: int, link: bool = True, add=add) -> None:
            ul = add(parent, pick(["ul", "ol"]))
            for _ in range(int(rng.integers(lo, hi + 1))):
                add(ul, "li", "", say(1, 3), 0, link)

        def junk(parent: int, add=add, listing=listing) -> None:
            kind = pick(["nav", "header", "aside", "footer", "ad", "notice", "form", "comments", "share", "menu", "side", "foot"])
            a = lambda *xs: f'class="{pick(xs)}"' if chance(0.9) else f'id="{pick(xs)}"'
            if kind in ("nav", "menu"):
                k = add(parent, "nav" if kind == "nav" else "div", "" if kind == "nav" and chance(0.6) else a("menu", "navbar", "breadcrumb", "main-nav", "nav"))
                listing(k, 2, 7)
            elif kind == "header":
                k = add(parent, "header", "" if chance(0.6) else a("header", "masthead", "site-header"), say(1, 6) if chance(0.5) else "")
                add(k, pick(["h1", "h2", "div", "p"]), "", say(1, 5))
            elif kind in ("aside", "side"):
                k = add(parent, "aside" if kind == "aside" else "div", "" if kind == "aside" and chance(0.5) else a("sidebar", "related", "widget", "side"), say(2, 30, ".") if chance(0.3) else "")
                if chance(0.6):
                    add(k, pick(["h2", "h3", "h4"]), "", say(1, 4))
                if chance(0.5):
                    listing(k, 2, 5, chance(0.7))
                if chance(0.5):
                    add(k, "p", "", say(3, 50, "."))
            elif kind in ("footer", "foot"):
                k = add(parent, "footer" if kind == "footer" else "div", "" if kind == "footer" and chance(0.7) else a("footer", "copyright", "legal"), say(3, 25, ".") if chance(0.7) else "")
                if chance(0.4):
                    add(k, "p", "", say(2, 20, "."))
                if chance(0.3):
                    listing(k, 2, 4)
            elif kind == "ad":
                k = add(parent, pick(["div", "div", "section", "aside", "p"]), a("ad", "ads", "advert", "sponsored", "promo", "banner", "ad-box"), say(2, 60, ".") if chance(0.8) else "")
                if chance(0.4):
                    add(k, "p", "", say(2, 30, "."))
            elif kind == "notice":
                k = add(parent, pick(["div", "div", "section", "dialog"]), a("cookie-notice", "cookie", "consent", "notice", "popup", "modal", "alert"), say(4, 30, ".") if chance(0.7) else "")
                if chance(0.5):
                    add(k, "p", "", say(3, 30, "."))
                if chance(0.5):
                    add(k, "button", "", say(1, 2))
            elif kind == "form":
                k = add(parent, "form", "" if chance(0.5) else a("search", "newsletter", "signup", "login"), say(1, 6) if chance(0.5) else "")
                if chance(0.5):
                    add(k, pick(["p", "div", "fieldset"]), "", say(1, 15, "."))
                if chance(0.6):
                    add(k, "button", "", say(1, 2))
                if chance(0.2):
                    s = add(k, "select")
                    add(s, "option", "", say(1, 2))
                if chance(0.2):
                    add(k, "textarea", "", say(1, 9))
            elif kind == "comments":
                k = add(parent, pick(["div", "section", "ol", "ul"]), a("comments", "comment-list", "replies", "discussion", "reader-comments"))
                if chance(0.5):
                    add(k, pick(["h2", "h3"]), "", say(1, 3))
                for _ in range(int(rng.integers(1, 5))):
                    c = add(k, pick(["div", "li", "article"]), "" if chance(0.3) else a("comment", "reply", "comment-body"), say(3, 50, ".") if chance(0.4) else "")
                    add(c, pick(["p", "p", "div"]), "", say(3, 70, "."))
            else:
                k = add(parent, "div", a("share", "social", "follow", "subscribe"), say(1, 5) if chance(0.5) else "")
                listing(k, 1, 4)

        def prose(parent: int, add=add, brief=brief) -> None:
            for _ in range(int(rng.integers(1, 3 if brief else 9))):
                what = rng.random()
                if what < 0.62:
                    add(parent, "p", 'class="text"' if chance(0.1) else "", say(1, 9 if brief else 90, "." if chance(0.9) else ""), 1, chance(0.03))
                elif what < 0.65:
                    d = add(parent, "dl", "", "", 1)
                    for _ in range(int(rng.integers(1, 5))):
                        add(d, "dt", "", say(1, 4), 1)
                        add(d, "dd", "", say(1, 25, "."), 1)
                elif what < 0.72:
                    add(parent, pick(["pre", "pre", "address", "div", "div", "section"]), "", say(1, 40, pick(["", "."])), 1)
                elif what < 0.8:
                    add(parent, pick(["h2", "h3", "h4"]), "", say(1, 8), 1)
                elif what < 0.88:
                    ul = add(parent, pick(["ul", "ol"]), "", "", 1)
                    for _ in range(int(rng.integers(1, 5))):
                        add(ul, "li", "", say(1, 20, "."), 1)
                elif what < 0.93:
                    q = add(parent, pick(["blockquote", "figure", "pre"]), "", say(2, 30, ".") if chance(0.6) else "", 1)
                    if chance(0.5):
                        add(q, pick(["p", "figcaption"]), "", say(2, 30, "."), 1)
                elif what < 0.96:
                    b = add(add(parent, "table", "", "", 1), "tr", "", "", 1)
                    for _ in range(3):
                        add(b, pick(["td", "th"]), "", say(1, 4), 1)
                else:
                    d = add(parent, pick(["div", "section"]), "", say(2, 30, ".") if chance(0.5) else "", 1)
                    add(d, "p", "", say(3, 60, "."), 1)

        head = add(0, "head")
        add(head, "title", "", say(2, 9))
        body = add(0, "body", "", "", 1)
        place = body
        if chance(0.3):
            place = add(body, "div", pick(["", 'class="page"', 'id="wrapper"', 'class="container"']), "", 1)
        for _ in range(int(rng.integers(0, 4))):
            junk(place)
        if chance(0.3):
            place = add(place, pick(["main", "div", "section"]), pick(["", 'id="content"', 'class="main"', 'role="main"', 'class="row"']), "", 1)
            if chance(0.3):
                junk(place)
        if chance(0.85):
            shape = pick(["article", "article", "div", "main", "section"])
            attrs = pick(["", "", 'class="post"', 'class="article-body"', 'class="entry-content"', 'id="content"']) if shape in ("article", "main") else pick(['class="content"', 'class="post"', 'id="article"', 'class="story"', ""])
            bare = chance(0.08)  # text without blocks
            art = add(place, shape, attrs, say(3, 12 if brief else 60, ".") if bare or chance(0.15) else "", 1)
        else:
            art, bare = place, False
        if chance(0.7):
            hold = art
            if chance(0.15):
                hold = add(art, "header", "", "", 1)
            add(hold, "h1", "", say(1, 12), 1)
        if not bare:
            prose(art)
        for _ in range(int(rng.integers(0, 3))):
            if not bare and chance(0.4):
                junk(art)
                prose(art)
        if place == body or chance(0.7):
            for _ in range(int(rng.integers(0, 4))):
                junk(place)
        if chance(0.6):
            f = add(body, "footer", "", say(2, 20, "."))
            if chance(0.3):
                add(f, "p", "", say(2, 20, "."))
        trees.append(t)
        labels.append(y)
    return trees, labels


@functools.lru_cache(maxsize=1)
def model() -> tuple[np.ndarray, np.ndarray]:
    return train(*labelled_pages())


def main_texts(pages: list[str], w: np.ndarray, pair: np.ndarray) -> list[str]:
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    p, _ = forest.marginals(w, pair)
    out = []
    for base, t in zip(forest.first.tolist(), trees, strict=False):
        keep = (p[base : base + len(t.parent)] > 0.5).tolist()
        blocks, last, held = [], -1, []
        for node, text, _link in t.parts:
            if node != last:
                if held:
                    blocks.append("".join(held))
                held, last = [], node
            if keep[node]:
                held.append(text)
        if held:
            blocks.append("".join(held))
        out.append(" ".join(" ".join(blocks).split()))
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    w, pair = model()
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                cut = batch.slice(at, 100)
                texts = main_texts(cut.column("html").to_pylist(), w, pair)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("page_id"), cut.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
