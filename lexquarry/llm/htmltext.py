r"""HTML extraction: content marginals of a tree-structured graphical model over the DOM.

A page's block elements form a tree (inline elements belong to the text of their block; end tags that were
left out are implied). Each node has a label, content or not. Its own potential is log-linear in structure: its
tag and parent's tag, where it stands to the page's article and to the element that holds most text, place among
its like, length of text, share of links and of the page; and in names (class, id, role), its own and those of what it
stands in, as far as training pages have them. What the whole page stands in (its body, and what is above both its
article and the element of most text) passes no names on, since they tell nothing apart. A name counts as a whole; of one made of parts, as `ad-hoc-networks`,
the parts count as parts. A parent-child potential says how labels follow each other, by kind of the child.
Sum-product messages upward and downward give exact marginals, and blocks of nodes likelier content than not make
the text.

Training is piecewise, on labelled pages: the node potential by logistic regression, the edge potentials
by smoothed counts. No table holds labelled pages, so they are composed here from page templates
(labelled_pages), with content and furniture in the places where sites put them. Half of the pages name nothing, or
name things by words drawn for that page alone, so what isn't named must be told by structure.

Cases. A null or empty page and one without content give an empty text. Character references are decoded,
white space in a block becomes one space, blocks are trimmed and joined by two \n. Comments, scripts, styles,
titles, form fields, templates and iframes are never text, but of these only scripts and styles run on without an
end tag; a head ends with the first element of the body. Formulas, text in drawings (svg) and noscript are text of
their block; objects are nodes. A tag cut off at the end is dropped. Depth and length are not limited. Rows
are handled one by one; other columns are kept if carried.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Container
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.llm.spark import prepare

_MATH = frozenset("math annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_SVG = frozenset("svg g path circle ellipse rect line polyline polygon text tspan textpath use symbol defs marker mask pattern clippath lineargradient radialgradient stop filter desc metadata animate animatetransform set view switch".split())
_INLINE = _MATH | _SVG | frozenset("noscript a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Inline elements that part words.
_SPACE = frozenset("br mspace mtd mtr annotation annotation-xml text desc svg noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped to their end tag; without one, scripts and styles to the end of the page, of a title the text before the next tag, and of the others the start tag alone.
_RAW = frozenset("script style template textarea title iframe select".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag ends an open element of these, unless one of the second kind lies between.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
_TAG = re.compile(r"""<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")


class Page:
    """tags, attrs and parents of the block elements in page order, and blocks: (node, raw text, characters in links)."""

    def __init__(self, source: str):
        self.tags, self.attrs, self.parents = ["#"], [""], [-1]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._text, self._linked, self._in_link = [0], [], 0, 0
        self._counts: Counter = Counter()  # open elements by tag
        ends: dict[str, dict[int, int]] = {}
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            end, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if end:
                self._close(name)
            elif name in ("script", "style"):
                stop = _raw_end(name).search(source, at)
                at = stop.end() if stop else len(source)
            elif name in _RAW:
                if name not in ends:
                    ends[name] = _ends_of(name, source)
                if m.start() in ends[name]:
                    at = ends[name][m.start()]
                else:
                    self._flush()
                    if name == "title":
                        cut = source.find("<", at)
                        at = cut if cut >= 0 else len(source)
            else:
                self._open(name, attrs)
        if at < len(source):
            self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            self.blocks.append((self._stack[-1], "".join(self._text), self._linked))
            self._text = []
        self._linked = 0

    def _open(self, name: str, attrs: str) -> None:
        if name in _INLINE:
            if name == "a":
                self._in_link = 1
            elif name in _SPACE:
                self._text.append(" ")
            return
        self._flush()
        self._in_link = 0
        if name in _VOID or name == "head":  # what may stand in a head is void or skipped; anything else ends it
            if name == "hr":
                self._up({"p"}, set())
            return
        if name in _ENDS_P:
            self._up({"p"}, {"td", "th", "li", "table"})
        if name in _ENDS:
            self._up(*_ENDS[name])
        self.tags.append(name)
        self.attrs.append(attrs)
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.tags) - 1)
        self._counts[name] += 1

    def _end(self, at: int) -> None:
        """Closes the open elements from this place of the stack on."""
        self._counts.subtract(self.tags[i] for i in self._stack[at:])
        del self._stack[at:]

    def _up(self, ended: set[str], unless: set[str]) -> None:
        """Closes the outermost open element of `ended` within the nearest of `unless`."""
        if not any(self._counts[t] for t in ended):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag in unless:
                return
            if tag in ended:
                self._end(i)
                return

    def _close(self, name: str) -> None:
        if name in _INLINE:
            if name == "a":
                self._in_link = 0
            return
        self._flush()
        self._in_link = 0
        if self._counts[name]:
            self._end(next(i for i in range(len(self._stack) - 1, 0, -1) if self.tags[self._stack[i]] == name))


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.I)


@cache
def _raw_tag(name: str) -> re.Pattern:
    return re.compile(rf"""<(/?){name}(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.I)


def _ends_of(name: str, source: str) -> dict[int, int]:
    """Where each start tag that has an end tag begins, and where that end tag ends; elements nest."""
    out, open_ = {}, []
    for m in _raw_tag(name).finditer(source):
        if m[1]:
            if open_:
                out[open_.pop()] = m.end()
        else:
            open_.append(m.start())
    return out


def _clean(raw: str) -> str:
    return " ".join((html.unescape(raw) if "&" in raw else raw).split())


@lru_cache(maxsize=4096)
def _words(attrs: str) -> tuple[str, ...]:
    """`~name` for a whole name of class, id or role, `~+part` for the parts of one that has several."""
    out = []
    for m in _ATTR.finditer(attrs):
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and "display:none" in value.replace(" ", "")):
            out.append("~hidden")
        elif kind in ("class", "id", "role"):
            for name in value.split():
                parts = _NAME.findall(name)
                out += ["~" + w for w in parts] if len(parts) == 1 else ["~+" + w for w in parts]
    return tuple(dict.fromkeys(out))


_REGIONS = frozenset("nav aside footer form header article main section".split())


def _binned(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


def _placed(parents: list[int], node: int, inside: str = "in", above: str = "above", other: str = "out") -> list[str]:
    """Where each node stands to one: in it, above it, or elsewhere."""
    out = [other] * len(parents)
    up = node
    while up >= 0:
        out[up] = above
        up = parents[up]
    out[node] = inside
    for i in range(node + 1, len(parents)):
        if out[parents[i]] == inside:
            out[i] = inside
    return out


def node_features(page: Page, known: Container[str] | None = None) -> list[list[str]]:
    """Names of the features that hold for each node; of the names of what it stands in, those in `known` if given (a deep page can have any number)."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    own, linked, below, below_linked, signed = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    before, total = [0] * n, 0  # characters before a node's first text
    order = [-1] * n
    for node, raw, links in page.blocks:
        size = len(raw.strip())
        if size:
            if order[node] < 0:
                order[node] = total
            signed[node] = signed[node] or "\xa9" in raw or "&copy;" in raw
            own[node] += size
            linked[node] += min(links, size)
            total += size
    dense = [0] * n  # text without links of a node and its children, list items aside
    twins: Counter = Counter()
    for i in range(n - 1, -1, -1):
        below[i] += own[i]
        below_linked[i] += linked[i]
        dense[i] += own[i] - linked[i]
        if i:
            parent = parents[i]
            below[parent] += below[i]
            below_linked[parent] += below_linked[i]
            dense[parent] += own[i] - linked[i] if tags[i] != "li" else 0
            signed[parent] = signed[parent] or (signed[i] and below[i] < 300)
            twins[parent, tags[i], page.attrs[i]] += 1
    seen = 0
    for i in range(n):
        before[i] = seen = max(seen, order[i])
    fullest = max(range(n), key=lambda i: dense[i])
    main = _placed(parents, fullest)
    main = [m if m != "out" else "before" if i < fullest else "after" for i, m in enumerate(main)]
    titled = [False] * n  # holds a heading of the first rank
    for i in range(n - 1, 0, -1):
        titled[parents[i]] = titled[parents[i]] or titled[i] or tags[i] == "h1"
    outer = [False] * n  # stands in an article
    for i in range(1, n):
        outer[i] = outer[parents[i]] or tags[parents[i]] == "article"
    parts = [i for i in range(n) if tags[i] == "article" and not outer[i]] or [i for i in range(n) if tags[i] == "main"]
    article = _placed(parents, max(parts, key=lambda i: (titled[i], below[i]))) if parts else ["none"] * n
    # what all of the page stands in
    shared = [tags[i] in ("#", "html", "body") or (main[i] == "above" and article[i] == "above") for i in range(n)]
    out: list[list[str]] = []
    above: list[tuple[str, ...]] = [()] * n  # names of what a node stands in
    for i in range(n):
        tag, parent = tags[i], parents[i]
        length = _binned(own[i], 1, 25, 80, 250)
        share = 0 if not below_linked[i] else 1 + _binned(below_linked[i] / below[i], 0.3, 0.7)
        place = f"{article[i]} {main[i]}"
        like = _binned(twins[parent, tag, page.attrs[i]], 2, 3)
        out.append([
            tag, f"{tags[parent] if i else ''}>{tag}", f"length {length}", f"links {share}", f"place {place}", f"{tag} {place}", f"links {share} {place}", f"length {length} {place}",
            f"like {like} {place}", f"of page {_binned(below[i] / max(total, 1), 0.001, 0.05, 0.2, 0.5)} {place}", f"at {_binned(before[i] / max(total, 1), 0.0001, 0.1, 0.5, 0.9)} {place}", f"all {_binned(below[i], 1, 25, 80, 250)} links {share}",
            *((f"signed {place}",) if signed[i] else ()), *((f"list of {share} {article[i]} {'~' if page.attrs[i] else ''}",) if tag in ("ul", "ol") else ()),
            *(() if not page.attrs[i] else ["@" + w for w in _words(page.attrs[i])] if shared[i] else _words(page.attrs[i])),
        ])
        if i:
            above[i] = above[parent]
            own_words = (*(_words(page.attrs[parent]) if page.attrs[parent] and not shared[parent] else ()), *((tags[parent],) if tags[parent] in _REGIONS else ()))
            new = [w for w in dict.fromkeys("^" + w for w in own_words) if (known is None or w in known) and w not in above[parent]]
            if new:
                above[i] = (*new, *above[parent])
            out[-1] += above[i]
    return out


class Model:
    """weights of features; edges[kind of child] = potentials of (child, parent) labels 00, 01, 10, 11."""

    def __init__(self, weights: dict[str, float], bias: float, edges: dict[str, tuple[float, float, float, float]]):
        self.weights, self.bias, self.edges = weights, bias, edges

    @staticmethod
    def fit(pages: list[tuple[Page, list[int]]], steps: int = 7, shrink: float = 0.01) -> Model:
        by_page = [node_features(page) for page, _ in pages]
        feats = [f for own in by_page for f in own]
        # what few pages have, such as names drawn for one of them, is not learned
        seen = Counter(f for own in by_page for f in set().union(*own))
        names = sorted(f for f, k in seen.items() if k >= max(3, len(pages) // 150))
        place = {f: i for i, f in enumerate(names)}
        # nodes of the same features count as one, so many times
        kinds: dict[tuple[int, ...], list[int]] = defaultdict(lambda: [0, 0])
        for own, label in zip(feats, (v for _, labels in pages for v in labels), strict=True):
            kinds[tuple(sorted(place[f] for f in set(own) if f in place))][label] += 1
        x = np.zeros((len(kinds), len(names) + 1), np.float32)
        x[:, -1] = 1
        for row, own in enumerate(kinds):
            x[row, list(own)] = 1
        times, y = np.array([sum(k) for k in kinds.values()], np.float64), np.array([k[1] for k in kinds.values()], np.float64)
        w = np.zeros(x.shape[1])
        for _ in range(steps):  # Newton's steps on the penalised logistic loss
            slope, curve = shrink * w, shrink * np.eye(len(w))
            for part in range(0, len(x), 4096):
                own, want, n = x[part : part + 4096], y[part : part + 4096], times[part : part + 4096]
                p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
                slope = slope + own.T @ (n * p - want)
                curve = curve + own.T @ (own * (n * np.maximum(p * (1 - p), 1e-4)).astype(np.float32)[:, None])
            w = w - np.linalg.solve(curve, slope)
        w, b = w[:-1], w[-1]
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(4))
        for page, labels in pages:
            for i in range(1, len(labels)):
                both = 2 * labels[i] + labels[page.parents[i]]
                counts[page.tags[i]][both] += 1
                counts[""][both] += 1
        edges = {}
        for kind, c in counts.items():
            child, parent = (c[0] + c[1] + 0.5, c[2] + c[3] + 0.5), (c[0] + c[2] + 0.5, c[1] + c[3] + 0.5)
            total = c.sum() + 1
            # as if ten more had been seen in which the labels don't depend on each other
            c = (c + [10 * child[k >> 1] * parent[k & 1] / total**2 for k in range(4)]) / (c.sum() + 10)
            child, parent = [v / total for v in child], [v / total for v in parent]
            edges[kind] = tuple(float(c[k] / (child[k >> 1] * parent[k & 1])) for k in range(4))
        return Model({f: float(x) for f, x in zip(names, w, strict=True)}, float(b), edges)

    def marginals(self, page: Page) -> list[float]:
        """Log-odds of content for each node, given the whole page."""
        n, parents, exp, log = len(page.tags), page.parents, math.exp, math.log
        odds = [self.bias + sum(self.weights.get(f, 0.0) for f in own) for own in node_features(page, self.weights)]
        edges = [self.edges.get(t) or self.edges[""] for t in page.tags]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):  # all children of a node come after it
            p00, p01, p10, p11 = edges[i]
            r = exp(max(-30.0, min(30.0, odds[i])))
            up[i] = log((p01 + r * p11) / (p00 + r * p10))
            odds[parents[i]] += up[i]
        for i in range(1, n):
            p00, p01, p10, p11 = edges[i]
            r = exp(max(-30.0, min(30.0, odds[parents[i]] - up[i])))
            odds[i] += log((p10 + r * p11) / (p00 + r * p01))
        return odds


def extract(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = Page(source)
    odds = model.marginals(page)
    return "\n\n".join(t for node, raw, _ in page.blocks if odds[node] > 0 and (t := _clean(raw)))


def labelled_pages(n: int = 1500, seed: int = 5) -> list[tuple[Page, list[int]]]:
    """Composed pages. An attribute that the model doesn't see marks furniture (data-x="0": nothing under it is content), wrappers (data-x="1") and wrappers that hold content as text of their own (data-x="2")."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "to", "li", "sa", "mo", "ren", "ti", "ou", "es")) for _ in range(rng.randint(1, 4)))
    text = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{word()} {word()}</a>'
    off, wrap = ' data-x="0"', ' data-x="1"'
    names = {
        "ad": "ad ads advert advertisement sponsor sponsored promo banner",
        "menu": "menu nav navbar navigation breadcrumb breadcrumbs topbar toc pagination tabs",
        "side": "sidebar aside related recommended widget popular trending share social newsletter subscribe tags",
        "head": "header masthead logo branding site top",
        "foot": "footer copyright legal colophon bottom",
        "note": "cookie cookies consent notice gdpr popup modal alert overlay",
        "talk": "comments comment replies reply discussion disqus respond",
        "form": "form search login signup contact",
    }
    odd = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(5, 10)))
    layout = "box wrap inner left right top bottom main primary area block list bar content section slot".split()
    mode, drawn = "known", {}

    def name(k: str) -> str:
        """Known names, alone or with others that are known; or one drawn for the page; or none."""
        if mode == "none":
            return ""
        own = rng.choice(names[k].split())
        if mode == "known":
            value = rng.choice((own, own, own, own, f"{own}-{rng.choice(layout)}", f"{rng.choice(layout)}-{own}", f"{own}-{rng.choice(names[k].split())}"))
        else:
            value = drawn.setdefault(k, rng.choice((odd(), f"{odd()}-{odd()}")))
        return f'{rng.choice(("class", "id", "class"))}="{value}"'

    def wrapped(x: str) -> str:
        deep = rng.choice((0, 0, 0, 1, 3, 8, 20))
        return "".join(f'<div class="{odd()} {odd()}">' for _ in range(deep)) + x + "</div>" * deep

    def misled(x: str) -> str:
        """Content under a name that has a part known from furniture."""
        return f'<div class="{rng.choice(names[rng.choice(list(names))].split())}-{odd()}{rng.choice(("", "-" + odd()))}">{x}</div>'

    some = lambda f, a, b: "".join(f() for _ in range(rng.randint(a, b)))
    remark = lambda: wrapped(rng.choice((lambda: "", lambda: f"<{(h := rng.choice(('b', 'h4', 'span')))}>{text(1, 2)}</{h}>"))() + plain_remark())
    plain_remark = lambda: (lambda k, c: rng.choice((f"<{k}{c}>{text(4, 60)}</{k}>", f"<{k}{c}><p>{text(4, 60)}</p></{k}>")))(rng.choice(("div", "li", "article", "section")), rng.choice(("", " class=comment", " class=reply") if mode == "known" else ("",)))
    furniture: dict[str, Callable[[], str]] = {
        "nav": lambda: f"<nav{off}><ul>{some(lambda: f'<li>{link()}</li>', 2, 8)}</ul></nav>",
        "menu": lambda: f"<{(t := rng.choice(('div', 'ul', 'ul')))}{off} {name('menu')}>{some(lambda: f'<li>{link()}</li>' if t == 'ul' else link() + ' ', 2, 8)}</{t}>",
        "ad": lambda: f"<div{off} {name('ad')}>{rng.choice((text(3, 40), link(), f'<p>{text(3, 30)}</p>'))}</div>",
        "header": lambda: f"<{(t := rng.choice(('header', 'div')))}{off} {name('head')}><{(k := rng.choice(('div', 'h1', 'p', 'h2')))}>{text(1, 4)}</{k}>{some(link, 0, 4)}</{t}>",
        "plain header": lambda: f"<header{off}><{(k := rng.choice(('h1', 'div', 'p')))}>{rng.choice((link, lambda: text(1, 4)))()}</{k}>{rng.choice(('', furniture['nav']()))}</header>",
        "footer": lambda: f"<{(t := rng.choice(('footer', 'footer', 'div')))}{off} {name('foot')}>{rng.choice((f'&copy; {text(2, 12)}', f'<p>{text(4, 30)}</p>', f'<ul><li>{link()}</li></ul>'))}</{t}>",
        "lone remark": lambda: f"<div{off}>{wrapped(f'<p>{text(4, 60)}</p>')}</div>",
        "plain footer": lambda: f"<footer{off}>{text(2, 20)}</footer>",
        "aside": lambda: f"<{(t := rng.choice(('aside', 'div', 'section')))}{off} {name('side')}><h{(k := rng.randint(2, 4))}>{text(1, 3)}</h{k}>{rng.choice((some(lambda: f'<p>{link()}</p>', 1, 5), f'<p>{text(5, 40)}</p>'))}</{t}>",
        "plain aside": lambda: f"<aside{off}>{rng.choice((text(4, 40), f'<p>{text(5, 40)}</p><ul><li>{link()}</li></ul>'))}</aside>",
        "notice": lambda: f"<div{off} {name('note')}>{rng.choice((text(4, 30), f'<p>{text(4, 30)}</p>'))}<button>Ok</button></div>",
        "form": lambda: f"<form{off}><label>{text(1, 3)}</label><input name=q><p>{text(2, 12)}</p><button>Go</button></form>",
        "talk": lambda: f"<{(t := rng.choice(('div', 'section', 'ol')))}{off} {name('talk')}><h{(k := rng.randint(2, 4))}>{text(1, 3)}</h{k}>{some(remark, 1, 6)}</{t}>",
    }
    content = (
        lambda: f"<p>{text(8, 90)}</p>", lambda: f"<p>{text(8, 90)}</p>", lambda: f"<p>{text(1, 12)}</p>", lambda: f"<p>{text(20, 60)} {link()} {text(10, 40)}", lambda: f"<p><b>{text(2, 10)}<br>",
        lambda: f"<h{(k := rng.randint(2, 4))}>{text(1, 8)}</h{k}>", lambda: f"<ul>{some(lambda: f'<li>{text(2, 30)}', 2, 6)}</ul>", lambda: f"<ol>{some(lambda: f'<li>{text(2, 30)}</li>', 2, 6)}</ol>",
        lambda: f"<blockquote><p>{text(8, 50)}</p></blockquote>", lambda: f"<pre>{text(5, 40)}</pre>", lambda: f"<table><tr><td>{text(1, 5)}<td>{text(1, 5)}</table>", lambda: f"<figure><img src=x><figcaption>{text(3, 15)}</figcaption></figure>",
        lambda: f"<h2>{text(1, 4)}</h2><ul>{some(lambda: f'<li>{link()}</li>', 2, 8)}</ul>", lambda: misled(f"<p>{text(8, 60)}</p>"), lambda: misled(text(8, 60)),
        lambda: f"<div><p>{text(8, 60)}</p></div>", lambda: f"<section><h2>{text(1, 8)}</h2><p>{text(8, 60)}</p></section>",
    )
    loose = (
        lambda: f"{text(20, 120)}<br><br>{text(20, 90)}", lambda: f"<b>{text(2, 9)}</b> {text(20, 90)}", lambda: f"{text(60, 300)}\n", lambda: f"{text(10, 40)}<br>{text(10, 60)}<br>",
        lambda: f"{text(30, 90)} {link()} {text(20, 60)}<br><br>", lambda: f"<i>{text(10, 60)}</i><br>{text(20, 90)}",
    )

    def told_of_all() -> str:
        """Names that bodies and wrappers have for what they hold somewhere."""
        if mode == "none" or rng.random() < 0.6:
            return ""
        one = lambda: rng.choice((lambda k: k, lambda k: f"{rng.choice(('has', 'with', 'no', 'left', 'right', 'page', 'single'))}-{k}", lambda k: f"{k}-{rng.choice(('open', 'left', 'right', 'on', 'layout', 'page'))}"))(rng.choice(names[rng.choice(list(names))].split()))
        return " ".join(one() for _ in range(rng.choice((1, 1, 2, 3))))

    pages = []
    for _ in range(n):
        mode, drawn = rng.choice(("known", "known", "known", "drawn", "drawn", "none")), {}
        title = f"<h1>{text(2, 10)}</h1>"
        head = rng.choice((title, title, title, f"<header>{title}</header>", f"<header{rng.choice(('', ' class=entry-header'))}>{title}<p>{text(2, 8)}</p></header>", ""))
        body = head + some(lambda: rng.choice(content)(), 1, 12)
        # furniture within the article; without known names only what its elements tell
        within = ("ad", "ad", "ad", "aside", "talk", "menu", "form", "notice") if mode == "known" else ("nav", "plain aside", "form")
        for _ in range(rng.choice((0, 1, 2, 3) if mode == "known" else (0, 1, 2))):
            body += furniture[rng.choice(within)]() + rng.choice(content)()
        body += furniture["plain footer"]() * (rng.random() < 0.1)
        sure = (("<article>", "</article>"), ("<article>", "</article>"), (f'<article class="{odd()}">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"))
        told = (('<div class="post-content">', "</div>"), ('<section class="story">', "</section>"), ('<div id="content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="entry">', "</div>"), ("<div>", "</div>"), ("", ""))
        open_, close = rng.choice(sure + told if mode == "known" else sure + sure + told[-2:])
        bare = rng.random() < 0.15
        if bare and rng.random() < 0.5:
            open_ = close = ""
        often = rng.choice((0, 0.3, 0.4, 0.4, 0.5))
        straight = open_ == "" and rng.random() < 0.7
        if straight:  # text of the wrapper, the body or the page itself
            body = head * (rng.random() < 0.4) + some(lambda: rng.choice(loose)(), 1, 4) + rng.choice(("", body))
            often = rng.choice((0, 0, 0.3))
        apart = "article" in open_ or "main" in open_
        first, last = ("header", "plain header", "nav", "menu", "notice", "ad", "form", "plain aside"), ("aside", "plain aside", "talk", "ad", "footer", "plain footer", "notice")
        if mode != "known" and not apart:  # nothing would tell these from content
            first, last = [k for k in first if k not in ("notice", "ad")], [k for k in last if k not in ("ad", "notice", "aside")]
        if apart:
            last = ("lone remark", *last) if rng.random() < 0.5 else (*last, "lone remark")
        before = "".join(furniture[k]() for k in first if rng.random() < often)
        after = "".join(furniture[k]() for k in last if rng.random() < often)
        inside = f"{before}{open_}{body}{close}{after}"
        mark = "2" if straight else "1"  # of the innermost wrapper, if any
        for _ in range(rng.choice((0, 0, 1, 2))):
            name_ = rng.choice(("wrapper", "container", "page", "site", "row", "layout", "main-wrap", "inner"))
            inside = f'<div data-x="{mark}" {rng.choice(("class", "id"))}="{told_of_all() or name_}">{inside}</div>'
            mark = "1"
        body_names = f' class="{x}"' if (x := told_of_all()) else ""
        html_names = f' class="{x}"' if rng.random() < 0.2 and (x := told_of_all()) else ""
        page = Page(f'<html{html_names}><body data-x="{mark}"{body_names}>{inside}</body></html>' if not bare else inside)
        labels = []
        for i, parent in enumerate(page.parents):
            outer = lambda k: page.tags[k] in ("#", "html", "body") or wrap in page.attrs[k]
            if ' data-x="2"' in page.attrs[i] or (i == 0 and bare and mark == "2"):
                labels.append(1)
            else:
                labels.append(0 if outer(i) or off in page.attrs[i] or not (outer(parent) or labels[parent]) else 1)
        pages.append((page, labels))
    return pages


@cache
def train(n: int = 1500) -> Model:
    return Model.fit(labelled_pages(n))


def _extracted(model: Model):
    def body(batches):
        for batch in batches:
            texts = [extract(s.as_py(), model) for s in batch.column(0)]
            rest = range(1, batch.num_columns)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "_text", "_n_chars"])

    return body


def extract_pages(pages: DataFrame, model: Model, *, html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns `carry` of each page, _text and _n_chars (code points)."""
    prepare(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "_text string", "_n_chars long"])
    return pages.select(F.col(html_col).alias("_html"), *carry).mapInArrow(_extracted(model), schema)
