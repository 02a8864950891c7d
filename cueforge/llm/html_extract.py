"""Main-text extraction: a linear-chain conditional random field over a page's DOM leaf blocks.

A page becomes a sequence of leaf blocks, the runs of text between block-level tags. Each block has features of
its ancestors (tags, class and id words, roles) and of its text (length, link share, end mark, place). The field
has two states, article and rest; it is trained on labelled pages by gradient ascent on the likelihood and
decoded by Viterbi. The labelled pages are made by labelled_pages(): a seeded generator of layouts.
"""

from __future__ import annotations

import functools
import random
import re
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp template svg".split())
#: Without an end tag these take the rest of the page, as in browsers; the others of _RAW are then taken as empty.
_TO_THE_END = frozenset(("script", "style"))
#: Numeric character references of so many digits: Python refuses to read numbers of thousands.
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
#: An unquoted value at the end of a tag: a slash there belongs to the value.
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+\Z""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in _RAW}
#: An opening tag of these ends the open ones named, up to the given borders.
_SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_P_BORDER = frozenset(("td", "th", "table", "button", "caption", "html", "template"))


class Node:
    """An open element that says something of its blocks: features that no ancestor has, and the way up.

    near is the closest block-level element, itself included.
    """

    __slots__ = ("parent", "tag", "fresh", "near", "scored")

    def __init__(self, parent: Node | None, tag: str, fresh: tuple[str, ...], is_block: bool):
        self.parent, self.tag, self.fresh = parent, tag, fresh
        self.near = self if is_block or parent is None else parent.near
        self.scored: tuple[Field, float] | None = None

    def own(self) -> list[str]:
        """The features by place: the innermost tag and its parent."""
        up = self.parent
        return [f"at:{up.tag}>{self.tag}" if up and up.tag else f"at:{self.tag}"] if self.tag else ["at:"]


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


def _short_reference(m: re.Match) -> str:
    digits = m[0].strip("&#;xX").lstrip("0")
    is_hex = m[0][2] in "xX"
    return f"&#{'x' * is_hex}{digits or 0};" if len(digits) < 9 else "\ufffd"


def _decoded(raw: str) -> str:
    return unescape(_LONG_REFERENCE.sub(_short_reference, raw)) if "&" in raw else raw


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str] | int]:
    """(start, end, is an end tag, name or "" for comments and declarations, attributes) of each tag; send() goes on from a later place.

    A tag ends at the first > outside quotes that close. Where a tag never ends, quotes count for nothing from there on, so
    that every byte is looked at a bounded number of times.
    """
    at, last, quotes = 0, html.rfind(">"), True
    last_of = {'"': html.rfind('"'), "'": html.rfind("'")}
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            stop = stop + 3 if stop >= 0 else len(html)
            at = (yield start, stop, False, "", "") or stop
            continue
        if start > last:
            return
        if html.startswith(("<!", "<?"), start):
            stop = html.find(">", start) + 1
            at = (yield start, stop, False, "", "") or stop
            continue
        m = _NAME.match(html, start + 1)
        if not m:
            at = start + 1
            continue
        p = m.end()
        while quotes and (edge := _EDGE.search(html, p)) and edge[0] != ">":
            p = edge.end()
            if p <= last_of[edge[0]]:
                p = html.find(edge[0], p) + 1
        if quotes and not edge:
            quotes, p = False, m.end()
        stop = edge.end() if quotes else html.find(">", p) + 1
        at = (yield start, stop, bool(m[1]), m[2].lower(), html[m.end() : stop - 1]) or stop


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order: texts with character references decoded and white space made single spaces.

    Scripts, styles, templates, titles, drawings (svg) and comments hold no blocks; the text of formulas (math) stays. Open
    tags are closed as browsers do for paragraphs, list items and table cells; end tags without a partner are
    ignored. Time and memory grow with the page, however deep or broken it is.
    """
    out: list[Block] = []
    nodes = [Node(None, "", (), False)]  # one per open element; elements without features share their parent's
    names = [""]
    places: dict[str, list[int]] = {}  # tag: where it stands on the stack
    held: dict[str, int] = {}  # feature: how many open elements have it
    mine: list[list[str]] = [[]]
    text: list[str] = []
    linked = at = 0
    endless: set[str] = set()  # raw elements that have no further end tag

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(nodes[-1].near, joined, linked))
            text, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        piece = _decoded(raw)
        text.append(piece)
        if places.get("a"):
            linked += len(piece)

    def pop(k: int) -> None:
        while len(names) > k:
            places[names.pop()].pop()
            nodes.pop()
            for f in mine.pop():
                held[f] -= 1

    def top(found: Iterable[str]) -> int:
        return max((places[x][-1] for x in found if places.get(x)), default=0)

    reader = _tags(html)
    tag = next(reader, None)
    while tag:
        start, stop, ends, name, attributes = tag
        if start > at:
            add(html[at:start])
        at, is_block = stop, name in _BLOCK
        if ends:
            if is_block:
                close()
            if places.get(name):
                pop(places[name][-1])
            tag = next(reader, None)
            continue
        if is_block:
            close()
            if (p := top(("p",))) and p > top(_P_BORDER):
                pop(p)
            if name in _SIBLINGS:
                same, border = _SIBLINGS[name]
                low = top(border)
                after = [places[x][bisect_right(places[x], low)] for x in same.split() if places.get(x) and places[x][-1] > low]
                if after:
                    pop(min(after))
        elif name == "br":
            text.append(" ")
        empty = attributes.endswith("/")
        if name in _RAW and not (name == "svg" and empty and not _UNQUOTED.search(attributes)):
            end = None if name in endless else _RAW_END[name].search(html, at)
            if end:
                at = html.find(">", end.end()) + 1 or len(html)
            elif name in _TO_THE_END:
                at = len(html)
            else:
                endless.add(name)
            tag = _sent(reader, at)
            continue
        if name and name not in _VOID and not (empty and not is_block):
            words = sorted({w for x in _ATTR.findall(attributes) for w in _WORD.findall("".join(x[1:]).lower())}) if attributes else []
            told = [f"in:{name}", *[f"word:{w}" for w in words]] if is_block or words else []
            fresh = tuple(f for f in told if not held.get(f))
            for f in told:
                held[f] = held.get(f, 0) + 1
            places.setdefault(name, []).append(len(names))
            names.append(name)
            mine.append(told)
            nodes.append(Node(nodes[-1], name, fresh, is_block) if told else nodes[-1])
        tag = next(reader, None)
    if at < len(html):
        add(html[at:])
    close()
    return out


def _sent(reader: Generator, at: int):
    try:
        return reader.send(at)
    except StopIteration:
        return None


def path_features(node: Node) -> set[str]:
    """Features of the ancestors: each tag, each class or id word, the innermost tag and its parent."""
    out = set(node.own())
    while node:
        out.update(node.fresh)
        node = node.parent
    return out


def text_features(b: Block, i: int, n: int) -> list[str]:
    size = len(b.text)
    out = [f"size:{min(size.bit_length(), 9)}"]
    if b.linked * 2 > size:
        out.append("linked")
    if b.text[-1] in ".!?:;\"')":
        out.append("ended")
    if i < 2:
        out.append("top")
    if i >= n - 2:
        out.append("tail")
    if "\xa9" in b.text or "(c)" in b.text:
        out.append("copyright")
    return out


class Field:
    """Weights of a trained field. Only differences between the two states matter, so each feature has one weight."""

    def __init__(self, weights: dict[str, float], bias: float, moves: list[list[float]], start: float):
        self.weights, self.bias, self.moves, self.start = weights, bias, moves, start

    def of_node(self, node: Node) -> float:
        """The summed weights of an element's and its ancestors' features but those by place; each element is summed once."""
        todo = []
        while node and not (node.scored and node.scored[0] is self):
            todo.append(node)
            node = node.parent
        s = node.scored[1] if node else 0.0
        for x in reversed(todo):
            s += sum(self.weights.get(f, 0.0) for f in x.fresh)
            x.scored = (self, s)
        return s

    def score(self, b: Block, i: int, n: int) -> float:
        return self.bias + self.of_node(b.node) + sum(self.weights.get(f, 0.0) for f in (*b.node.own(), *text_features(b, i, n)))

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: whether each block is of the article. Equal scores go to the rest."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves
        n = len(page)
        rest, article = 0.0, self.start + self.score(page[0], 0, n)
        back = []
        for i in range(1, n):
            s = self.score(page[i], i, n)
            to0, to1 = article + m10 > rest + m00, article + m11 > rest + m01
            back.append((to0, to1))
            rest, article = (article + m10 if to0 else rest + m00), s + (article + m11 if to1 else rest + m01)
        state = article > rest
        out = [state]
        for to0, to1 in reversed(back):
            state = to1 if state else to0
            out.append(state)
        return out[::-1]


def main_text(html: str | None, field: Field) -> str:
    """The article's blocks in page order, joined by blank lines; empty if there are none."""
    page = blocks(html or "")
    return "\n\n".join(b.text for b, keep in zip(page, field.decode(page), strict=True) if keep)


# --- labelled pages

_REST = ["nav", "menu", "header", "footer", "sidebar", "ad", "notice", "form", "related", "share", "comments"]


def labelled_pages(n: int = 600, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Made pages as (html, texts of the article's blocks): layouts drawn from a seeded generator."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice(("ka", "lo", "mi", "sur", "ven", "da", "pe", "fru", "\xf6", "\u017e", "bal", "gom", "\u043a\u043e", "\u8a9e")) for _ in range(r.randint(1, 4)))

    def sentence(low: int = 1, high: int = 30) -> str:
        w = [word() for _ in range(r.randint(low, high))]
        s = " ".join(w)
        kind = r.random()
        if kind < 0.1:
            s = s.upper().replace(" ", "!! ") + "!!"
        elif kind < 0.2:
            s = " ".join(x + r.choice(("***", "%%%", "$$$", "###")) for x in w)
        return (s[:1].upper() + s[1:]) + r.choice((".", ".", ".", "!", "", "?"))

    def link() -> str:
        return f'<a href="/{word()}">{word()}</a>'

    def rest(kind: str) -> str:
        c = r.choice
        if kind in ("nav", "menu", "related", "share"):
            items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
            wrap = {"nav": c(("nav", 'div class="nav"', 'div id="navigation"')), "menu": c(("nav", 'div class="menu"', 'menu class="menu"')), "related": c(('div class="related"', 'aside class="related posts"', 'section class="recommended"')), "share": c(('div class="share"', 'div class="social share"', 'ul class="sharing"'))}[kind]
            return f"<{wrap}>{'<h3>' + word() + '</h3>' if r.random() < 0.3 else ''}<ul>{items}</ul></{wrap.split()[0]}>"
        if kind == "comments":
            wrap = c(('div class="comments"', 'section id="comments"', 'div class="comment list"', 'section class="reader comments"', 'ol class="commentlist"', 'div id="disqus" class="comments"'))
            body = "".join(f'<div class="comment"><b>{word()}</b><p>{sentence()}</p></div>' if r.random() < 0.7 else f'<article class="comment"><p>{sentence()}</p></article>' for _ in range(r.randint(1, 5)))
            return f"<{wrap}><h{c('234')}>{sentence(1, 3)}</h3>{body}</{wrap.split()[0]}>"
        if kind == "form":
            return f'<form action="/s"><label>{word()}</label><input name="q"><button>{word()}</button><select><option>{word()}</option></select></form>'
        wrap = {"header": c(("header", 'div class="header"', 'div id="masthead" class="site header"', 'header class="site header"')), "footer": c(("footer", "footer", 'div class="footer"', 'div id="footer"')), "sidebar": c(("aside", 'div class="sidebar"', 'aside class="sidebar"', 'div id="sidebar"', 'div class="widget"')), "ad": c(('div class="ad"', 'div class="ad"', 'div class="ads banner"', 'div class="advert"', 'div id="advertisement"', 'aside class="ad"', 'div class="sponsored"', 'p class="promo"')), "notice": c(('div class="cookie notice"', 'div class="notice"', 'div id="cookie" class="banner"', 'div role="alert" class="consent"', 'div class="newsletter subscribe"', 'div class="popup"'))}[kind]
        inner = sentence()
        if kind == "footer":
            inner = c(("&copy; ", "\xa9 ", "Copyright ", "")) + word() + ".example &middot; " + sentence()
        inner = f"<p>{inner}</p>" if r.random() < 0.4 and not wrap.startswith("p") else inner
        return f"<{wrap}>{inner}</{wrap.split()[0]}>"

    pages = []
    for _ in range(n):
        truth: list[str] = []

        def keep(s: str) -> str:
            truth.append(" ".join(s.split()))
            return s.replace("&", "&amp;")

        wrap = r.choice(("article", "article", "main", 'div class="content"', 'div class="article body"', 'div id="content"', 'section class="post"', 'div class="entry"', 'main role="main"', 'article class="post story"', 'div class="text"'))
        body = [f"<h1>{keep(sentence(1, 8))}</h1>"] if r.random() < 0.9 else []
        for k in range(r.choice((0, 1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            text = lambda: keep(" ".join(sentence() for _ in range(r.choice((1, 1, 2, 4)))))
            if kind < 0.35:
                body.append(f"<p>{text()}</p>")
            elif kind < 0.6:
                body.append(f"<p><b>{text()}<br>")
            elif kind < 0.68:
                body.append(f"<h{r.choice('23')}>{keep(sentence(1, 6))}</h2>")
            elif kind < 0.76:
                body.append("<ul>" + "".join(f"<li>{keep(sentence())}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.82:
                body.append(f"<blockquote><p>{text()}</p></blockquote>")
            elif kind < 0.86:
                body.append(f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>")
            elif kind < 0.9:
                body.append("<table>" + "".join(f"<tr><td>{keep(word())}</td><td>{keep(word())}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                body.append(f"<div><p>{text()}</p></div>")
            else:
                body.append(rest(r.choice(("ad", "share", "related", "notice", "form"))))
        if r.random() < 0.3:
            body.append(rest("comments"))
        pre = [rest(x) for x in r.sample(_REST[:-1], r.randint(1, 5))]
        post = [rest(x) for x in r.sample(_REST[3:], r.randint(1, 5))]
        doc = f'<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{"".join(pre)}<{wrap}>{"".join(body)}</{wrap.split()[0]}>{"".join(post)}</body></html>'
        pages.append((doc, [t for t in truth if t]))
    return pages


def _labels(page: list[Block], truth: list[str]) -> list[int]:
    """Aligns an article's texts to blocks in order; the article is one run in which rests may be interspersed."""
    # the generator's article stands in one container: match from its start, greedily
    best: list[int] = [0] * len(page)
    if not truth:
        return best
    starts = [i for i, b in enumerate(page) if b.text == truth[0]]
    top = (0, best)
    for s in starts:
        got, k = [0] * len(page), 0
        for i in range(s, len(page)):
            if k < len(truth) and page[i].text == truth[k]:
                got[i], k = 1, k + 1
        top = max(top, (k, got), key=lambda x: x[0])
    return top[1]


def train(pages: list[tuple[str, list[str]]] | None = None, steps: int = 250, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Fits a field to labelled pages (default: labelled_pages()) by Adam on the exact log-likelihood."""
    seqs = []
    names: dict[str, int] = {}
    for html, truth in pages if pages is not None else labelled_pages():
        page = blocks(html)
        if page:
            feats = [[names.setdefault(f, len(names)) for f in (*sorted(path_features(b.node)), *text_features(b, i, len(page)))] for i, b in enumerate(page)]
            seqs.append((feats, _labels(page, truth)))
    n, longest = len(seqs), max((len(s[1]) for s in seqs), default=0)
    if not n:
        return Field({}, 0.0, [[0.0, 0.0], [0.0, 0.0]], 0.0)
    y, live = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    row, col = [], []
    for p, (feats, labels) in enumerate(seqs):
        y[p, : len(labels)], live[p, : len(labels)] = labels, True
        for i, fs in enumerate(feats):
            row += [p * longest + i] * len(fs)
            col += fs
    row, col, f = np.array(row), np.array(col), len(names)
    size = f + 6  # features, bias, start, four moves
    w, m1, m2 = np.zeros(size), np.zeros(size), np.zeros(size)
    pair_live = live[:, 1:]
    for step in range(1, steps + 1):
        emit = np.bincount(row, w[col], n * longest).reshape(n, longest) + w[f]
        moves = w[f + 2 :].reshape(2, 2)
        e = np.stack([np.zeros_like(emit), emit], 2)
        e[:, 0, 1] += w[f + 1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            step_a = np.logaddexp(alpha[:, i - 1, 0, None] + moves[0], alpha[:, i - 1, 1, None] + moves[1]) + e[:, i]
            alpha[:, i] = np.where(live[:, i, None], step_a, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            nxt = beta[:, i + 1] + e[:, i + 1]
            step_b = np.logaddexp(moves[:, 0] + nxt[:, 0, None], moves[:, 1] + nxt[:, 1, None])
            beta[:, i] = np.where(live[:, i + 1, None], step_b, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * live
        err = (y - p1) * live
        g = np.zeros(size)
        g[:f] = np.bincount(col, err.reshape(-1)[row], f)
        g[f], g[f + 1] = err.sum(), err[:, 0].sum()
        for a in range(2):
            for b in range(2):
                joint = np.exp(alpha[:, :-1, a] + moves[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * pair_live
                g[f + 2 + 2 * a + b] = (((y[:, :-1] == a) & (y[:, 1:] == b)) * pair_live).sum() - joint.sum()
        g = g / n - decay * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    moves = w[f + 2 :].reshape(2, 2).tolist()
    return Field({k: float(w[i]) for k, i in names.items()}, float(w[f]), moves, float(w[f + 1]))


@functools.cache
def trained() -> Field:
    """The field of the default pages, fitted once in a process."""
    return train()


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages: the article's text. A null html is empty and has none; bytes that aren't UTF-8 are U+FFFD.

    The field is small and goes along with the function; pages are handled one at a time, whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py(), model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return spread(pages.selectExpr("cast(page_id as long) page_id", "make_valid_utf8(cast(url as string)) url", "make_valid_utf8(html) html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
