"""Main text of web pages by union-free wrapper inference for each host.

Each page is a tree of elements (block elements with their class, id and role) with
text slots. Trees of one host are aligned one after another into a wrapper, a regular
expression without unions: where they agree their elements stand, adjacent stretches of
equal siblings become a repeated group, and what some pages lack is optional, standing
in fewer pages than what it lies in. Text is always a slot. A slot is a position in the
wrapper. It carries what the host's pages hold there: in how many of them it is filled,
its mean share of a page's text, outside of links and in them, and whether its text
differs between pages.

A page is read through its host's wrapper: it is aligned with it, and each of its texts
takes the weight of its position: the position's mean share, little where the text is
the same on every page or lies under elements that are marked as menus, headers,
footers, sidebars, notices, adverts, forms or comments, and more within an article. The
main region is the deepest element with over half of that weight; marks on the
elements that hold it are void, so a page in a form or in a layout named after its
sidebar keeps its text. Where it lies in an article, every unmarked article is main text;
else the region is, without positions that hold links rather than text. What is marked
inside is left out. So long a text as one page may hold, it weighs as its position does on
the host. Text is never dropped for being the same on every page, as pages can be copies.

A wrapper is folded over the pages of each partition first, so a host of any size
sends small wrappers from each partition; these are aligned in groups, and the groups'
in turn, so that no task gathers them all. Pages of no host are read by themselves.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, materialize
from .urls import parts
from .words import as_utf8

#: Most siblings of a repeated group, and elements of all wrappers held at once in a task.
GROUP = 8
NODES_HELD = 200_000
#: Elements that need a class to be told apart, and how many alike make a repeated group.
BARE_NAMES, BARE = {"div", "section"}, 4
#: Elements under others to this depth form the tree; deeper ones stand beside each other.
DEPTH = 100
#: Elements of a wrapper over which those of one page alone are let go, when wrappers
#: are put together; a page's slot that its wrapper lacks weighs by the page itself.
WRAPPER_NODES = 20_000
#: Pairs of siblings up to which likeness of contents weighs in an alignment.
LIKENESS_PAIRS = 40_000
#: Groups that a host's partial wrappers are aligned in, before those are aligned.
ALIGN_GROUPS = 64
#: Bytes of all hosts' wrappers up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Weight of a text within an article, under a mark, and with the same text on all of at
#: least SAME_PAGES pages.
ARTICLE, MARKED, SAME = 4.0, 0.25, 0.1
SAME_PAGES = 3

# Elements by how they are read.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button", "object", "canvas", "audio", "video", "math"}
CONTAINERS = {"html", "head", "body", "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "table", "tr", "td", "th", "ul", "ol", "dl", "figure", "fieldset", "details", "dialog", "menu"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "hr", "figcaption", "address", "tbody", "thead", "tfoot", "caption", "summary", "center", "option", "legend", "label"}
BOILERPLATE = {"head", "nav", "footer", "aside", "menu", "dialog", "label", "legend"}
FORMS = {"form", "fieldset"}
STATES = {"has", "no", "not", "with", "without"}
OTHERS = {"ad", "ads", "comment", "comments", "discussion", "disqus", "replies", "reply", "respond", "responses", "sponsor", "sponsored"}
TABLE = {"table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
# An element of the first kind ends an open one of the second, up to one of the third.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form", "menu", "menubar", "toolbar"}
CLASS_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "alert", "alerts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus",
    "footer", "form", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "reaction", "reactions",
    "recommended", "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "teasers", "toolbar", "warning", "widget", "widgets",
}

CLASS_STARTS = ("advert", "breadcrumb", "comments", "cookie", "gdpr", "newsletter", "promo", "sidebar", "sponsor", "subscri")
SWALLOWS = {"script", "style", "textarea", "title", "template", "noscript"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


@lru_cache(maxsize=65536)
def _key(name: str, attributes: str) -> str:
    """An element's name with its class and role, and its id where that says something; digits flattened."""
    found = {m[1].lower(): next(x for x in m.groups()[1:] if x is not None) for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    values = {k: " ".join(v.lower().split()) for k, v in found.items() if v.strip()}
    if "id" in values and not any(_says(w) for w in _words(values["id"])):
        del values["id"]
    return name + re.sub(r"[0-9]+", "0", "".join(f"|{k}={values[k]}" for k in ("class", "id", "role") if k in values))


def _says(word: str) -> bool:
    return word in CLASS_WORDS or word.startswith(CLASS_STARTS)


def _words(value: str) -> Iterator[str]:
    """Words of class names or ids, but of those that say what a page has or lacks (has-sidebar)."""
    for name in value.split():
        words = re.split(r"[^a-z]+", name)
        if STATES.isdisjoint(words):
            yield from words


@lru_cache(maxsize=65536)
def _marked(key: str, in_article: bool) -> int:
    """2 if an element's name says that it is no main text, or its class that it is an advert
    or a comment in an article; 1 if its role or class says so elsewhere or it is a form,
    else 0. Headers belong to an article that they stand in."""
    if key.startswith("("):
        return 0
    name, *marks = key.split("|")
    if name in BOILERPLATE or name == "header" and not in_article:
        return 2
    for m in marks:
        kind, _, value = m.partition("=")
        words = [value] if kind == "role" else [w for w in _words(value) if _says(w) and not (in_article and w in ("header", "masthead"))]
        if in_article and kind != "role" and any(w in OTHERS or w.startswith("advert") for w in words):
            return 2
        if words if kind != "role" else value in ROLES:
            return 1
    return int(name in FORMS)


@lru_cache(maxsize=65536)
def _is_article(key: str) -> bool:
    return not key.startswith("(") and (key.split("|")[0] in ("article", "main") or "|role=main" in key or "|role=article" in key)


# -- trees -----------------------------------------------------------------------------

SLOT = "#"


class Node:
    """An element or a slot of a page or a wrapper.

    ``key`` names it (a group's key joins its members'), ``pages`` counts those that
    have it. A slot has ``stat``: its shares of its pages' text outside of links and in
    them, summed over pages, a sum of its text, and whether that differs between pages.
    A page's slots have ``texts``, the numbers of their texts.
    """

    __slots__ = ("key", "kids", "pages", "repeated", "stat", "texts")

    def __init__(self, key: str, kids: list | None = None, repeated: bool = False, pages: int = 1, stat: list | None = None):
        self.key, self.kids, self.repeated, self.pages, self.stat, self.texts = key, kids or [], repeated, pages, stat, []

    def pack(self) -> list:
        return [self.key, int(self.repeated), self.pages, self.stat, [k.pack() for k in self.kids]]

    @classmethod
    def unpack(cls, row: list) -> Node:
        return cls(row[0], [cls.unpack(k) for k in row[4]], bool(row[1]), row[2], row[3])

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)

    def expression(self) -> str:
        """The wrapper as a regular expression: ``+`` repeated, ``?`` optional."""
        within = " ".join(k.expression() + ("?" if k.pages < self.pages else "") for k in self.kids)
        name = "" if self.key.startswith("(") else self.key
        return (f"{name}({within})" if self.kids else name) + ("+" if self.repeated else "")


def _slots(node: Node) -> Iterator[Node]:
    for k in node.kids:
        if k.key == SLOT:
            yield k
        else:
            yield from _slots(k)


def read(page: str) -> tuple[Node, list[str | None]]:
    """A page's tree, and its texts in order with None where a block begins or ends.

    A block element that is not closed ends where the next of its kind begins or its
    parent ends; a closing tag closes the nearest open element of its name, if any, and
    none across a table. Inline elements are no part of the tree but where they are
    marked. Text in raw elements and comments is left out.
    """
    root = Node("")
    names, nodes = [""], [root]  # of the open elements
    texts: list[str | None] = []
    links, space, at, end = 0, False, 0, len(page)

    def close(down: int) -> None:
        del names[down:], nodes[down:]

    def add(text: str) -> None:
        nonlocal space
        kids = nodes[-1].kids
        blank = text.isspace()
        if not kids or kids[-1].key != SLOT:
            if blank:
                space = True
                return
            kids.append(Node(SLOT, stat=[0, 0, 0, 0]))
        slot = kids[-1]
        slot.texts.append(len(texts))
        texts.append(f" {text}" if space else text)
        space = False
        if not blank:
            slot.stat[1 if links else 0] += len(text.strip())
            slot.stat[2] = zlib.crc32(text.strip().encode("utf-8", "replace"), slot.stat[2])

    def start(name: str, key: str) -> None:
        parent = nodes[-1]
        node = Node(key)
        if len(nodes) <= DEPTH:
            parent.kids.append(node)
        else:
            nodes[DEPTH].kids.append(node)
        names.append(name)
        nodes.append(node)

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            add(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                found = _RAW_END[name].search(page, at)
                at = found.end() if found else end if name in SWALLOWS else at
        elif m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                texts.append(None)
                space = False
            if name in names:
                down = len(names) - 1 - names[::-1].index(name)
                over = names[down + 1 :]
                if not (name not in TABLE and not TABLE.isdisjoint(over) or name not in BLOCKS and not BLOCKS.isdisjoint(over)):
                    close(down)
        elif name == "br":
            add(" ")
        elif name in BLOCKS:
            texts.append(None)
            space = False
            if name != "hr":
                if "p" in names:
                    down = len(names) - 1 - names[::-1].index("p")
                    if BLOCKS.isdisjoint(names[down + 1 :]):
                        close(down)
                if name in ENDS:
                    ended, limit = ENDS[name]
                    for down in range(len(names) - 1, 0, -1):
                        if names[down] in limit:
                            break
                        if names[down] in ended:
                            close(down)
                            break
                if name in CONTAINERS:
                    links = 0
                start(name, _key(name, m[3]))
        elif name == "a":
            links += 1
            if m[3] and _marked(key := _key(name, m[3]), True):
                start(name, key)
        elif name not in VOID and m[3] and not m[3].endswith("/") and _marked(key := _key(name, m[3]), True):
            start(name, key)
    total = sum(s.stat[0] + s.stat[1] for s in _slots(root)) or 1
    for s in _slots(root):
        s.stat[0] /= total
        s.stat[1] /= total
    _collapse_all(root)
    return root, texts


def _collapse_all(node: Node) -> None:
    for k in node.kids:
        if k.kids:
            _collapse_all(k)
    node.kids = collapse(node.kids)


def _shape(node: Node) -> tuple:
    return node.key, tuple(_shape(k) for k in node.kids)


def collapse(kids: list[Node]) -> list[Node]:
    """Adjacent stretches of up to GROUP siblings with equal keys made one repeated group,
    shortest first, with their contents aligned.

    Elements without a class say little: a stretch with one is repeated only where
    BARE times as many stand in a row and are built alike.
    """
    out = kids
    for size in range(1, GROUP + 1):
        now, i = [], 0
        while i < len(out):
            keys = [k.key for k in out[i : i + size]]
            j = i + size
            while j + size <= len(out) and [k.key for k in out[j : j + size]] == keys:
                j += size
            if not BARE_NAMES.isdisjoint(keys) and j > i + size:
                shapes = [_shape(k) for k in out[i : i + size]]
                j = next((n for n in range(i + size, j, size) if [_shape(k) for k in out[n : n + size]] != shapes), j)
                j = j if j - i >= BARE * size else i + size
            if j == i + size or len(keys) < size:
                now.append(out[i])
                i += 1
                continue
            for at in range(i + size, j, size):
                for own, more in zip(out[i : i + size], out[at : at + size], strict=True):
                    absorb(own, more, False)
            group = out[i] if size == 1 else Node(f"({' '.join(keys)})", out[i : i + size])
            group.repeated = True
            now.append(group)
            i = j
        out = now
    return out


def absorb(own: Node, more: Node, other_pages: bool) -> None:
    """Align ``more`` into ``own``; as the same page's or as other pages'."""
    own.repeated |= more.repeated
    own.texts += more.texts
    if other_pages:
        own.pages += more.pages
    if own.stat is not None and more.stat is not None:
        own.stat[0] += more.stat[0]
        own.stat[1] += more.stat[1]
        if other_pages:
            own.stat[3] |= more.stat[3] | (own.stat[2] != more.stat[2])
        else:
            own.stat[2] = zlib.crc32(b"%d" % more.stat[2], own.stat[2])
    if own.kids or more.kids:
        own.kids = merge(own.kids, more.kids, other_pages)


def _grouped(kids: list[Node], groups: list[Node]) -> list[Node]:
    """Siblings with every single stretch that has a known group's keys made that group."""
    known = {tuple(m.key for m in g.kids): g.key for g in groups if len(g.kids) > 1}
    if not known:
        return kids
    out, i, sizes = [], 0, sorted({len(k) for k in known}, reverse=True)
    while i < len(kids):
        for n in sizes:
            if key := known.get(tuple(k.key for k in kids[i : i + n])):
                out.append(Node(key, kids[i : i + n], False, max(k.pages for k in kids[i : i + n])))
                i += n
                break
        else:
            out.append(kids[i])
            i += 1
    return out


def merge(a: list[Node], b: list[Node], other_pages: bool) -> list[Node]:
    """The siblings of all that ``a`` or ``b`` describes; a's nodes stay, with b's aligned into them."""
    a, b = _grouped(a, [k for k in b if k.key[0:1] == "("]), _grouped(b, [k for k in a if k.key[0:1] == "("])
    out, i, j = [], 0, 0
    for x, y in [*align(a, b), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            absorb(a[x], b[y], other_pages)
            out.append(a[x])
        i, j = x + 1, y + 1
    return out


def align(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of places of equal keys, in order: as many as can be, the likest contents first."""
    ka, kb = [k.key for k in a], [k.key for k in b]
    if ka == kb:
        return [(i, i) for i in range(len(a))]
    head = 0
    while head < min(len(ka), len(kb)) and ka[head] == kb[head] and ka.count(ka[head]) == kb.count(kb[head]) == 1:
        head += 1
    tail = 0
    while tail < min(len(ka), len(kb)) - head and ka[-1 - tail] == kb[-1 - tail] and ka.count(ka[-1 - tail]) == kb.count(kb[-1 - tail]) == 1:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    if n * m > LIKENESS_PAIRS:
        names = {k: i for i, k in enumerate(sorted({*ka, *kb}))}
        pairs = _common(np.array([names[k] for k in ka[head : head + n]]), np.array([names[k] for k in kb[head : head + m]]))
    else:
        pairs = _likest(a[head : head + n], b[head : head + m])
    same = [(i, i) for i in range(head)]
    return same + [(i + head, j + head) for i, j in pairs] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _likest(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    n, m = len(a), len(b)
    within_a, within_b = [{k.key for k in x.kids} for x in a], [{k.key for k in x.kids} for x in b]
    like = lambda p, q: len(p & q) / max(1, len(p | q))
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    worth = [[1 + like(within_a[i], within_b[j]) if a[i].key == b[j].key else 0.0 for j in range(m)] for i in range(n)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = worth[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + w if w else 0.0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if worth[i][j] and best[i][j] == best[i + 1][j + 1] + worth[i][j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A longest common subsequence of long lists, halved so that memory stays linear."""

    def ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        row = np.zeros(len(y) + 1, np.int64)
        for v in x:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
        return row

    if not len(a) or not len(b):
        return []
    if len(a) == 1:
        at = np.flatnonzero(b == a[0])
        return [(0, int(at[0]))] if len(at) else []
    half = len(a) // 2
    cut = int(np.argmax(ends(a[:half], b) + ends(a[half:][::-1], b[::-1])[::-1]))
    return _common(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _common(a[half:], b[cut:])]


# -- wrappers --------------------------------------------------------------------------


class Wrapper:
    """A host's wrapper: a tree whose slots hold what its pages have there."""

    def __init__(self, root: Node | None = None):
        self.root = root or Node("", pages=0)

    def add(self, page: Node) -> None:
        for s in _slots(page):
            s.texts = []
        absorb(self.root, page, True)

    def dump(self) -> str:
        return json.dumps(self.root.pack(), ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(Node.unpack(json.loads(text)))

    def join(self, other: Wrapper) -> None:
        absorb(self.root, other.root, True)
        if self.root.size() > WRAPPER_NODES:
            _prune(self.root)

    def place(self, page: Node) -> dict[int, Node]:
        """The wrapper's slot of each of a page's slots, by identity, where there is one."""
        out: dict[int, Node] = {}
        _place(self.root.kids, page.kids, out)
        return out


def _prune(node: Node) -> None:
    node.kids = [k for k in node.kids if k.pages > 1]
    for k in node.kids:
        _prune(k)


def _place(own: list[Node], page: list[Node], out: dict[int, Node]) -> None:
    a, b = _grouped(own, [k for k in page if k.key[0:1] == "("]), _grouped(page, [k for k in own if k.key[0:1] == "("])
    for i, j in align(a, b):
        if b[j].key == SLOT:
            out[id(b[j])] = a[i]
        else:
            _place(a[i].kids, b[j].kids, out)


class _Slot:
    """A page's slot with the elements that it lies in, what they say, and its weight."""

    def __init__(self, node: Node, path: list[Node], at: Node | None):
        self.node, self.path, self.marks, self.article = node, path, [], False
        weight = 1.0
        for x in path:
            if mark := _marked(x.key, self.article):
                self.marks.append((x, mark))
                weight *= MARKED if mark == 1 else 0.0
            self.article = self.article or _is_article(x.key)
        if self.article:
            weight *= ARTICLE
        pages = at.pages if at else 1
        if at and pages >= SAME_PAGES and not at.stat[3]:
            weight *= SAME
        self.plain, self.links = (v / pages for v in (at or node).stat[:2])
        self.weight = weight

    def fine(self, above: set[int]) -> bool:
        """Whether no mark stands but such as are void: weak ones on what holds the region."""
        return all(mark == 1 and id(x) in above for x, mark in self.marks)


def _paths(node: Node, path: list[Node], placed: dict[int, Node], out: list[_Slot]) -> None:
    for k in node.kids:
        if k.key == SLOT:
            out.append(_Slot(k, path, placed.get(id(k))))
        else:
            _paths(k, [*path, k], placed, out)


def main_slots(page: Node, wrapper: Wrapper) -> list[Node]:
    """The slots of a page that hold its main text, by its host's wrapper."""
    slots: list[_Slot] = []
    _paths(page, [], wrapper.place(page), slots)
    mass = [s.plain * s.weight for s in slots]
    if not any(mass):
        mass = [s.links * s.weight for s in slots]
    total = sum(mass)
    if not total:
        return []
    inside: dict[int, float] = {}
    for s, m in zip(slots, mass, strict=True):
        for x in s.path:
            inside[id(x)] = inside.get(id(x), 0.0) + m
    # the elements that hold over half of the weight, each within the one before
    chain: list[Node] = []
    kids = page.kids
    while held := next((k for k in kids if 2 * inside.get(id(k), 0.0) > total), None):
        chain.append(held)
        kids = held.kids
    while chain and chain[-1].key.split("|")[0] not in CONTAINERS:
        chain.pop()
    above = {id(x) for x in chain}
    fine = [s.fine(above) for s in slots]
    stories = [s.article and ok for s, ok in zip(slots, fine, strict=True)]
    if 2 * sum(m for m, ok in zip(mass, stories, strict=True) if ok) > total:
        return [s.node for s, ok in zip(slots, stories, strict=True) if ok]
    region = id(chain[-1]) if chain else None
    within = [s for s, ok in zip(slots, fine, strict=True) if ok and (region is None or any(id(x) == region for x in s.path))]
    return [s.node for s in within if s.links <= s.plain] if any(s.plain >= s.links > 0 or s.plain > 0 == s.links for s in within) else [s.node for s in within]


def extract(page: Node, texts: list[str | None], wrapper: Wrapper) -> str:
    """The text in the main slots: references decoded, blocks trimmed and joined by newlines."""
    chosen = {t for s in main_slots(page, wrapper) for t in s.texts}
    blocks: list[str] = []
    now: list[str] = []
    for n, text in enumerate([*texts, None]):
        if text is None:
            line = " ".join(entities.unescape("".join(now)).split())
            if line:
                blocks.append(line)
            now = []
        elif n in chosen:
            now.append(text)
    return "\n".join(blocks)


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> Wrapper:
    return Wrapper.load(wrapper)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Wrapper] = {}
    group = TaskContext.get().partitionId() % ALIGN_GROUPS

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"host": pa.array(list(held), pa.string()), "part": pa.array([group] * len(held), pa.int32()), "wrapper": pa.array([w.dump() for w in held.values()], pa.string())})
        held.clear()
        return out

    for batch in batches:
        for url, page in zip(as_utf8(batch.column(0)).to_pylist(), as_utf8(batch.column(1)).to_pylist(), strict=True):
            if host := parts(url)[0]:  # pages of no host have no wrapper in common
                held.setdefault(host, Wrapper()).add(read(page)[0])
        if sum(w.root.size() for w in held.values()) > NODES_HELD:
            yield flush()
    yield flush()


def _align(table: pa.Table) -> pa.Table:
    whole = Wrapper()
    for text in sorted(table.column("wrapper").to_pylist()):
        whole.join(Wrapper.load(text))
    return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([whole.dump()], pa.string())})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, inferred from all of its pages.

    Null and empty pages count as pages without elements, pages whose url is null or has
    no host for none, repeated rows as often as they come; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    part = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_infer, "host string, part int, wrapper string")
    part = part.groupBy("host", "part").applyInArrow(_align, "host string, wrapper string")
    return materialize(part.groupBy("host").applyInArrow(_align, "host string, wrapper string"), "html-wrappers")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    text holds the blocks of main text joined by newlines, n_chars its code points.
    Null and empty html give an empty text; pages whose url is null or has no host are
    read each by itself; rows with a null or repeated id are read like any other; an empty table
    gives no rows; other columns are ignored.
    """
    fresh(pages, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    known = wrappers(pages, url_col, html_col)
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    host = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def text(html: str, wrapper: str | None) -> str:
        page, texts = read(html)
        return extract(page, texts, _loaded(wrapper) if wrapper else Wrapper())

    def written(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield written(batch, [text(p, w) for p, w in zip(as_utf8(batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield written(batch, [text(p, shared.value.get(h)) for p, h in zip(as_utf8(batch.column(2)).to_pylist(), batch.column(3).to_pylist(), strict=True)])

    out = f"id {kind}, url string, text string, n_chars long"
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in known.collect()})
        discard(known)
        read_rows = rows.select("id", "url", "html", "host").mapInArrow(looked_up, out)
    else:
        read_rows = rows.join(known, "host", "left").select("id", "url", "html", "wrapper").mapInArrow(joined, out)
    return read_rows.withColumnRenamed("id", id_col)
