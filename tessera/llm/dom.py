"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded from the root down.

A page is parsed into its block elements. Trees score each for holding main text, from subtree density, links,
attribute tokens, depth and siblings. A dynamic programme over the tree then takes the likeliest choice in which a
dropped element drops all below it. The model is trained here, on pages from a seeded generator that knows the answer.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sigmoid

# Element names by kind, as HTML defines them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noscript template noembed noframes xmp".split())
SKIPPED = frozenset("head svg math button select object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Parts of class, id and role names by what they usually mark.
TOKENS = {
    "main": "article articlebody content entry main maincontent post postbody story text body prose blog news hentry".split(),
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc sitemap skip tabs toolbar".split(),
    "head": "header masthead banner logo topbar branding hero site-header".split(),
    "foot": "footer foot copyright legal contentinfo colophon bottom imprint".split(),
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations popular trending more readmore promo teaser teasers".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored dfp adsense taboola outbrain".split(),
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog paywall subscribe subscription newsletter signup privacy warning disclaimer announcement".split(),
    "form": "form search searchbox login signin register contact input feedback poll survey".split(),
    "talk": "comment comments commentlist reply replies respond discussion disqus thread reactions response responses forum review reviews".split(),
    "share": "share sharing social follow facebook twitter tags tag tagcloud meta print toolbar author-box byline".split(),
}
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: The end of a start tag, or an attribute's name and its value (quoted by ", by ', or bare); never goes back.
_ATTR = re.compile(r"""[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+)""")
_USED = frozenset("class id role hidden aria-hidden style aria-label".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TAGS = {"body": 0, "html": 0, "main": 1, "article": 1, "p": 2, "div": 3, "section": 3, "li": 4, "ul": 4, "ol": 4, "dl": 4, "td": 5, "tr": 5, "table": 5, "tbody": 5, "blockquote": 2, "pre": 2, "h1": 6, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "header": 7, "hgroup": 7, "nav": 8, "menu": 8, "footer": 9, "aside": 10, "form": 11, "fieldset": 11, "search": 11, "dialog": 12, "figure": 13, "figcaption": 13}
KINDS = tuple(TOKENS)
FEATURES = ("tag", "is_p", "is_heading", "depth", *(f"own_{k}" for k in KINDS), *(f"above_{k}" for k in KINDS), *(f"holds_{k}" for k in KINDS), "hidden", "in_article", "bad_above", "chars", "link_share", "density", "paragraphs", "stops", "siblings", "place", "of_parent", "of_page", "before", "holds_main_tag", "controls", "items")


class Node:
    __slots__ = ("tag", "parent", "depth", "kinds", "hidden", "chars", "linked", "tags", "paragraphs", "stops", "controls", "items", "start", "children", "below", "place")

    def __init__(self, tag: str, parent: int, depth: int, kinds: int, hidden: bool, start: int) -> None:
        self.tag, self.parent, self.depth, self.kinds, self.hidden, self.start = tag, parent, depth, kinds, hidden, start
        self.chars = self.linked = self.tags = self.paragraphs = self.stops = self.controls = self.items = self.below = self.place = 0
        self.children: list[int] = []


@cache
def _word_kinds() -> dict[str, int]:
    return {w: sum(1 << i for i, k in enumerate(KINDS) if w in TOKENS[k]) for ws in TOKENS.values() for w in ws}


def _start_tag(source: str, at: int) -> tuple[int, tuple[tuple[str, str], ...]]:
    """End of the tag whose name ends at ``at`` (the source's if it never ends) and its attributes in use, read whole;
    of repeated attributes the first counts."""
    gt = source.find(">", at)
    if gt <= at:
        return (gt + 1, ()) if gt == at else (len(source), ())
    found: dict[str, str] = {}
    while at < len(source):
        m = _ATTR.match(source, at)
        at = m.end()
        if m[1]:
            break
        name = m[2].lower()
        if name in _USED:
            found.setdefault(name, m[3] or m[4] or m[5] or "")
    return at, tuple(found.items())


def _attributes(found: tuple[tuple[str, str], ...]) -> tuple[int, bool]:
    """Kinds of tokens (as bits) in class, id, role; whether the element is hidden. Short ones are remembered."""
    return _short_attributes(found) if sum(len(v) for _, v in found) <= 200 else _read_attributes(found)


@lru_cache(maxsize=1 << 14)
def _short_attributes(found: tuple[tuple[str, str], ...]) -> tuple[int, bool]:
    return _read_attributes(found)


def _read_attributes(found: tuple[tuple[str, str], ...]) -> tuple[int, bool]:
    kinds, hidden = 0, False
    for name, value in found:
        if name in ("class", "id", "role", "aria-label"):
            for w in _SPLIT.split(_CAMEL.sub("-", value).lower()):
                kinds |= _word_kinds().get(w, 0)
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return kinds, hidden


def parse(source: str | None) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the first is the page itself) and (element, text) of each block of text."""
    source = source or ""
    nodes, blocks = [Node("html", -1, 0, 0, False, 0)], []
    stack: list[int] = [0]
    run: list[str] = []
    link = seen = 0
    skip = ""
    cur = nodes[0]

    def flush() -> None:
        nonlocal seen
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((stack[-1], text))
                cur.chars += len(text)
                cur.stops += text.count(".") + text.count(",")
                seen += len(text)

    def pop() -> None:
        nonlocal cur
        stack.pop()
        cur = nodes[stack[-1]]

    at, end = 0, len(source)
    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not skip:
            piece = source[at:lt]
            run.append(piece)
            if link:
                cur.linked += len(piece)
        if lt >= end:
            break
        if source.startswith("<!--", lt):
            gt = source.find("-->", lt + 4)
            at = end if gt < 0 else gt + 3
            continue
        m = _NAME.match(source, lt + 1)
        if not m:
            if source[lt + 1 : lt + 2] in ("!", "?", "/"):
                gt = source.find(">", lt)
                at = end if gt < 0 else gt + 1
            else:  # a bare <
                if not skip:
                    run.append("<")
                at = lt + 1
            continue
        at, found = _start_tag(source, m.end())
        name, closing = m[1].lower(), source[lt + 1] == "/"
        if skip:
            if (closing and name == skip) or (not closing and name in BLOCKS and (skip != "head" or name != "html")):
                skip = ""
                if closing:
                    continue
            else:
                if not closing and name in RAW:
                    close = re.compile(f"</{name}", re.I).search(source, at)
                    at = close.start() if close else end
                continue
        if closing:
            if name in BLOCKS:
                flush()
                if any(nodes[k].tag == name for k in stack[1:]):
                    while nodes[stack[-1]].tag != name:
                        pop()
                    pop()
            elif name == "a":
                link = 0
            continue
        cur.tags += 1
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(source, at)
            at = close.start() if close else end
            cur.controls += name == "textarea"
        elif name in SKIPPED:
            cur.controls += name in ("button", "select")
            skip = name
            if name == "head":
                flush()
        elif name in BLOCKS:
            flush()
            if name in ("html", "body") and any(nodes[k].tag == name for k in stack):
                continue
            while cur.tag == "p":
                pop()
            if name in CLOSES:
                same, bounds = CLOSES[name]
                for depth in range(len(stack) - 1, 0, -1):
                    tag = nodes[stack[depth]].tag
                    if tag in bounds:
                        break
                    if tag in same:
                        while len(stack) > depth:
                            pop()
            kinds, hidden = _attributes(found)
            node = Node(name, stack[-1], len(stack), kinds, hidden, seen)
            node.place = len(cur.children)
            cur.children.append(len(nodes))
            stack.append(len(nodes))
            nodes.append(node)
            cur = node
            link = 0
        elif name == "a":
            link = 1
        elif name in ("br", "hr", "img", "wbr"):
            run.append(" " if name != "wbr" else "")
        elif name == "input":
            cur.controls += 1
    flush()
    for n in reversed(nodes):  # children come after their parents
        n.paragraphs += n.tag == "p"
        n.items += n.tag == "li"
        if n.parent >= 0:
            p = nodes[n.parent]
            for k in ("chars", "linked", "stops", "paragraphs", "controls", "items"):
                setattr(p, k, getattr(p, k) + getattr(n, k))
            p.tags += n.tags
            p.below |= n.below | n.kinds | (1 << len(KINDS) if n.tag in ("article", "main") else 0)
    return nodes, blocks


def node_features(nodes: list[Node]) -> np.ndarray:
    k, total = len(KINDS), max(1, nodes[0].chars)
    out = np.zeros((len(nodes), len(FEATURES)))
    above = [0] * len(nodes)
    inside, bad = [0] * len(nodes), [0] * len(nodes)
    bits = np.array([1 << i for i in range(k)])
    own, over, held = np.zeros(len(nodes), int), np.zeros(len(nodes), int), np.zeros(len(nodes), int)
    rows = []
    for i, n in enumerate(nodes):
        tag = TAGS.get(n.tag, 3)
        if n.parent >= 0:
            p = nodes[n.parent]
            above[i] = above[n.parent] | p.kinds
            inside[i] = inside[n.parent] or p.tag in ("article", "main")
            bad[i] = bad[n.parent] + (TAGS.get(p.tag, 3) in (8, 9, 10, 11, 12)) + p.hidden
            siblings, place, of = len(p.children), n.place, n.chars / max(1, p.chars)
        else:
            siblings, place, of = 1, 0, 1.0
        own[i], over[i], held[i] = n.kinds, above[i], n.below
        rows.append((tag, n.tag == "p", tag == 6, n.depth, n.hidden, inside[i], bad[i], np.log1p(n.chars), n.linked / max(1, n.chars), n.chars / (1 + n.tags), n.paragraphs, n.stops / max(1, n.chars), siblings, place / siblings, of, n.chars / total, n.start / total, n.below >> k & 1, n.controls, n.items))
    r = np.array(rows, float)
    out[:, :4] = r[:, :4]
    for j, v in enumerate((own, over, held)):
        out[:, 4 + j * k : 4 + (j + 1) * k] = (v[:, None] & bits[None, :]) > 0
    out[:, 4 + 3 * k :] = r[:, 4:]
    return out


@dataclass
class Boosted:
    """Trees of equal depth as arrays: (trees, inner nodes) of feature and cut, (trees, leaves) of values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of holding main text."""
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), int)
            while inner and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += v[at - inner]
        return z


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 24, l2: float = 2.0) -> Boosted:
    """Second-order boosting on binned features, level by level; deterministic."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    b = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    p = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(p / (1 - p)))
    z = np.full(n, base)
    inner = 2**depth - 1
    feats, edges, values = [], [], []
    flat = (b + np.arange(d) * bins).astype(np.int64)
    for _ in range(trees):
        q = sigmoid(z)
        g, h = q - y, q * (1 - q)
        f, e, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                take = np.flatnonzero(at == node)
                if len(take) < 2:
                    continue
                w = d * bins
                idx = flat[take].ravel()
                lg = np.bincount(idx, np.repeat(g[take], d), w).reshape(d, bins).cumsum(1)
                lh = np.bincount(idx, np.repeat(h[take], d), w).reshape(d, bins).cumsum(1)
                tg, th = g[take].sum(), h[take].sum()
                gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
                gain[np.minimum(lh, th - lh) < 1e-3] = 0
                j, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, c] > 1e-6 and c < len(cuts[j]):
                    f[node], e[node] = j, cuts[j][c]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > e[at])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += v[leaf]
        feats.append(f)
        edges.append(e)
        values.append(v)
    return Boosted(np.array(feats), np.array(edges), np.array(values), base)


def decode(nodes: list[Node], score: np.ndarray) -> list[bool]:
    """The likeliest choice of kept elements in which whatever is below a dropped one is dropped too."""
    keep, drop = -np.logaddexp(0, -score), -np.logaddexp(0, score)
    best, gone = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        gone[p] += gone[i]
        best[p] += max(best[i], gone[i])
    out = [False] * len(nodes)
    for i, n in enumerate(nodes):
        out[i] = bool(best[i] > gone[i]) and (n.parent < 0 or out[n.parent])
    return out


# The generator of training pages: words are made up; layouts vary in elements, attributes, order and mark-up faults.

_SYL = ("ba", "ce", "di", "fo", "gu", "lan", "mer", "nis", "or", "pel", "qui", "ras", "sto", "tre", "um", "ver")
_CLASS = {"nav": ("nav", "menu", "navbar", "breadcrumbs", "pagination"), "head": ("header", "masthead", "site-header", "topbar"), "foot": ("footer", "site-footer", "copyright", "colophon"), "side": ("sidebar", "widget", "related", "rail", "popular-posts", "read-more"), "ad": ("ad", "ads", "advert", "sponsored", "ad-slot", "promo ad"), "notice": ("cookie-notice", "consent", "notice", "newsletter", "alert", "popup", "subscribe-box"), "form": ("search", "contact-form", "login", "signup form"), "talk": ("comments", "comment-list", "replies", "discussion", "respond"), "share": ("share", "social", "tags", "share-buttons")}
_TAG = {"nav": ("nav", "div", "ul"), "head": ("header", "div"), "foot": ("footer", "div"), "side": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "p", "dialog"), "form": ("form", "div"), "talk": ("section", "div", "ol", "aside"), "share": ("div", "ul", "p")}


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, xs):  # noqa: ANN001, ANN201
        return self.r.choice(xs)

    def words(self, lo: int, hi: int) -> str:
        out = ["".join(self.r.choices(_SYL, k=self.r.randint(1, 3))) + self.pick(("", "", "", "", "", ",", ".")) for _ in range(self.r.randint(lo, hi))]
        return " ".join(out).capitalize()

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def attr(self, kind: str, bare: bool = True) -> str:
        if bare and self.chance(0.12):
            return ""
        return f' {self.pick(("class", "id", "class", "role" if kind == "nav" else "class"))}="{self.pick(_CLASS[kind])}"'

    def boiler(self, kind: str, inside_main: bool = False) -> str:
        tag = self.pick(_TAG[kind])
        attr = self.attr(kind, inside_main is False and tag != "p") if tag in ("div", "section", "p", "ul", "ol", "dialog") or self.chance(0.5) else ""
        if kind in ("nav", "share") or (kind in ("side", "foot") and self.chance(0.5)):
            item = [f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(self.r.randint(2, 8))]
            body = "".join(item) if tag in ("ul", "ol") else "<ul>" + "".join(item) + "</ul>" if self.chance(0.8) else " ".join(re.sub("</?li>", "", i) for i in item)
        elif kind == "form":
            body = f'<label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 15)}</p><button>{self.words(1, 2)}</button>'
        elif kind == "talk":
            inner = [f"<{t}{a}>{self.words(2, 70)}</{t}>" for t, a in ((self.pick(("p", "div", "li", "blockquote")), self.pick(("", ' class="comment"', ' class="reply"'))) for _ in range(self.r.randint(1, 6)))]
            body = (f"<h3>{self.words(1, 4)}</h3>" if self.chance(0.6) else "") + "".join(inner)
        elif kind == "head":
            body = self.pick((f'<a href="/">{self.words(1, 3)}</a>', f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 9)}</p>", self.words(1, 5)))
        elif kind == "ad":
            body = self.pick((self.words(3, 30), f"<p>{self.words(3, 25)}</p>", f'<a href="http://x.example">{self.words(2, 12)}</a>', f"{self.words(2, 9)}\n{self.words(2, 9)}"))
        elif kind == "notice":
            body = self.pick((self.words(4, 35), f"<p>{self.words(4, 30)}</p><button>{self.words(1, 2)}</button>", f"<h4>{self.words(1, 4)}</h4><p>{self.words(4, 20)}</p>"))
        elif kind == "side":
            body = f"<h3>{self.words(1, 4)}</h3>" + "".join(f"<p>{self.words(4, 35)}</p>" for _ in range(self.r.randint(1, 3)))
        else:
            body = self.pick((f"&copy; {self.words(1, 3)} &middot; {self.words(2, 20)}", f"<p>{self.words(3, 20)}</p>", f"&copy; x.example {self.words(2, 9)}\n{self.words(1, 9)}"))
        if tag == "p":
            body = re.sub(r"</?(p|h\d|ul|li)[^>]*>", " ", body)
        return f"<{tag}{attr}>{body}</{tag}>"

    def content(self) -> str:
        out = []
        for _ in range(self.r.randint(1, 11) if self.chance(0.9) else self.r.randint(12, 39)):
            form = self.r.random()
            text = self.words(1, 6) if self.chance(0.2) else self.words(5, 120)
            if form < 0.72:
                out.append(f"<p data-c=1>{text}</p>" if self.chance(0.8) else f"<p data-c=1><b>{text}<br>")
            elif form < 0.8:
                out.append(f"<h{self.pick((2, 3, 4))} data-c=1>{self.words(1, 9)}</h2>".replace("</h2>", "") + self.pick(("</h2>", "</h2>")))
                out[-1] = re.sub(r"<h(\d)(.*)</h2>", r"<h\1\2</h\1>", out[-1])
            elif form < 0.87:
                out.append("<ul>" + "".join(f"<li data-c=1>{self.words(2, 20)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif form < 0.91:
                out.append(f"<blockquote data-c=1>{text}</blockquote>")
            elif form < 0.94:
                out.append(f"<table><tr><td data-c=1>{self.words(1, 6)}</td><td data-c=1>{self.words(1, 6)}</td></tr></table>")
            elif form < 0.97:
                out.append(f"<pre data-c=1>{text}</pre>")
            else:
                out.append(f'<p data-c=1>{self.words(3, 20)} <a href="/x">{self.words(1, 4)}</a> {self.words(3, 40)}</p>')
            if self.chance(0.1):
                out.append(self.boiler(self.pick(("ad", "notice", "share", "side", "form")), True))
        return "".join(out)

    def page(self) -> str:
        title = f"<h1 data-c=1>{self.words(3, 14)}</h1>"
        inner = self.content()
        if self.chance(0.12):  # next to nothing on the page
            title, inner = f"<h1 data-c=1>{self.words(1, 3)}</h1>", f"<p data-c=1>{self.words(1, 4)}</p>" * self.r.randint(0, 2)
        if self.chance(0.15):
            inner += self.boiler("talk")
        if self.chance(0.15):
            title = f"<header>{title}</header>"
        if self.chance(0.12):
            title = ""
        holder = self.pick(("article", "article", "main", "div", "section", "div"))
        attr = "" if holder in ("article", "main") and self.chance(0.6) else f' class="{self.pick(("content", "post", "entry-content", "article-body", "story", "main", "text"))}"' if self.chance(0.85) else ""
        core = f"<{holder}{attr}>{title}{inner}</{holder}>"
        if self.chance(0.25):
            core = f'<main id="{self.pick(("main", "content", "page"))}">{core}{self.boiler("talk") if self.chance(0.4) else ""}</main>'
        before = [k for k, p in (("notice", 0.3), ("head", 0.5), ("nav", 0.75), ("form", 0.2), ("ad", 0.5), ("side", 0.15)) if self.chance(p)]
        after = [k for k, p in (("share", 0.25), ("ad", 0.25), ("talk", 0.4), ("side", 0.4), ("form", 0.2), ("nav", 0.1), ("foot", 0.85), ("notice", 0.15)) if self.chance(p)]
        body = "".join(map(self.boiler, before)) + core + "".join(map(self.boiler, after))
        if self.chance(0.25):
            body = f'<div id="{self.pick(("wrapper", "page", "container", "root"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def training_nodes(pages: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and answers (does an element hold main text) of generated pages' elements. The generator marks main
    blocks by an attribute that the parser doesn't see."""
    xs, ys = [], []
    for k in range(pages):
        source = _Maker(seed * 100_003 + k).page()
        nodes, _ = parse(source)
        tags = [m for m in re.finditer(r"<([a-z][a-z0-9]*)([^>]*)>", source) if m[1] in BLOCKS and m[1] != "html"]
        y = np.zeros(len(nodes))
        for i, m in enumerate(tags, 1):
            if "data-c=1" in m[2]:
                at = i
                while at >= 0:
                    y[at] = 1
                    at = nodes[at].parent
        xs.append(node_features(nodes))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


@cache
def model(pages: int = 700) -> Boosted:
    return boost(*training_nodes(pages))


def extract_many(sources: list[str | None], trees: Boosted) -> list[str]:
    """Main texts of whole pages, blocks in page order joined by newlines."""
    out, parsed = [], [parse(s) for s in sources]
    feats = [node_features(n) for n, _ in parsed]
    score = trees.score(np.concatenate(feats)) if feats else np.zeros(0)
    at = 0
    for (nodes, blocks), f in zip(parsed, feats, strict=True):
        kept = decode(nodes, score[at : at + len(f)])
        at += len(f)
        out.append("\n".join(t for i, t in blocks if kept[i]))
    return out


def extract_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = 64) -> DataFrame:
    """One row per row of ``pages``: id, url, text, n_chars (code points). Null and empty html has an empty text;
    repeated rows each come back; an empty table gives none. Nothing of a page is cut off."""
    sent = pages.sparkSession.sparkContext.broadcast(model())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                part = b.slice(lo, chunk)
                texts = extract_many(part.column(2).to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return pages.select(id_col, F.col(url_col).alias("url"), F.col(html_col).alias("_h")).mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars bigint")
