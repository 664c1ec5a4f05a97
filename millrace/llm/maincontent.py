"""Main text of web pages by a minimum cut.

A page is read into text blocks with the elements around them. A logistic classifier, fitted on
generated layouts (see layouts), turns a block's links, length, punctuation and tag and
the signs of the elements around it into its log-odds of being content; these are the capacities
to the two terminals. Blocks that follow one another, and blocks that are next children of one element,
are tied by edges that are the stronger the nearer they are in the document tree, and of the
order of the classifier's costs; where the signs around two blocks differ, they are weaker. The maximum flow separates content from boilerplate, so a short line
between paragraphs goes with them, whatever it looks like alone.

The signs of an element are its name, role, class and id. They fade with every element between it
and the block, and with the share of the page's text that it holds: what holds most of the page
isn't an advert. A class name counts by its head ("cookie-notice", not "legal-history"), and not
at all if it tells a state ("has-sidebar").

Blocks whose own evidence outweighs all their ties keep their label in any minimum cut; they are
settled first, so the flow runs only over what is really undecided.

Defined cases: a null or empty page has the empty text; unclosed elements, stray end tags, an
unfinished tag, comment or script at the end of the page do no harm; character references are
decoded; white space inside a block (and a line break) becomes one space; repeated pages give
repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import layouts

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title|noembed|noframes)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z](?:[^>]*>|.*\Z)""",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STOP = re.compile(r"[.!?…]")

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Bounds of a block's cost, and strengths of ties: to the next block, over the tree's distance, and to the next child.
MOST, NEXT, SIBLING = 5.0, 3.2, 0.8
#: A start tag closes these if one is open inside its nearest holder.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDER = frozenset("ul ol menu dl table select body article section main div aside nav footer header form blockquote".split())

#: Elements that hold boilerplate, and how sure a sign they are; the first do so whatever share of the page they hold.
ALWAYS = {"nav": 1.0, "footer": 1.0, "aside": 1.0, "menu": 1.0, "dialog": 1.0, "head": 2.0, "button": 1.0, "search": 1.0}
MOSTLY = {"form": 1.0, "header": 1.0, "fieldset": 1.0}
BY_ROLE = {"navigation": 1.0, "banner": 1.0, "complementary": 1.0, "contentinfo": 1.0, "search": 1.0, "form": 1.0, "alert": 1.0, "alertdialog": 1.0, "dialog": 1.0}
BAD = frozenset(
    "ad ads adv brand logo advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay breadcrumb breadcrumbs menu menus nav navbar navigation sidebar widget widgets footer masthead topbar toolbar social share sharing related recommended recommendations subscribe subscription newsletter signup login search pager pagination disclaimer copyright comment comments commentlist reply replies respond disqus feedback form skip tags teaser outbrain taboola header".split()
)
GOOD = frozenset("article content post entry story body main text maincontent bodytext articlebody".split())
#: Words that don't say what an element holds; the word before them does.
PLAIN = GOOD | frozenset("list box wrap wrapper container area section block inner outer item items link links bar panel holder row col column group left right top bottom primary secondary title label posts articles text wide small large global site page".split())
#: Words that make a name tell a state of the page.
STATE = frozenset("has no not with without is enabled disabled supports open closed free hide show single js".split())
#: How fast the signs of an element fade, for each element between it and the block.
FADE_ALWAYS, FADE_BAD, FADE_GOOD = 0.95, 0.8, 0.6


def _sign(name: str) -> int:
    """-1: the name of a class or id stands for boilerplate, 1: for content, 0: for neither."""
    parts = [x.lower() for x in _NAME.findall(name)]
    if not parts or not STATE.isdisjoint(parts):
        return 0
    for x in reversed(parts):
        if x in BAD:
            return -1
        if x not in PLAIN:
            return 0
    return 1 if not GOOD.isdisjoint(parts) else 0


def _element(name: str, attrs: str) -> tuple[float, float, float]:
    """Signs of one element: boilerplate for certain, boilerplate, content."""
    always, bad, good = ALWAYS.get(name, 0.0), MOSTLY.get(name, 0.0), float(name in ("article", "main"))
    whole = name in ("html", "body", "main")
    for key, a, b, c in _ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            signs = {_sign(x) for x in value.split()}
            if -1 in signs and not whole:
                bad, good = 1.0, 0.0
            elif 1 in signs:
                good = max(good, 0.7)
        elif key == "role":
            role = value.lower()
            bad = max(bad, BY_ROLE.get(role, 0.0))
            good = max(good, float(role in ("main", "article")))
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            always = 1.5
    return always, bad, good if not (bad or always) else 0.0


class Block:
    __slots__ = ("text", "links", "tag", "path", "signs", "control")

    def __init__(self, text: str, links: int, tag: str, path: tuple[int, ...], signs: tuple, control: float):
        self.text, self.links, self.tag, self.path, self.signs, self.control = text, links, tag, path, signs, control


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order with the elements around them."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, int]] = []  # open block elements: name, signs, number
    path: tuple[int, ...] = ()
    signs: tuple = ()
    parts: list[str] = []
    links = anchor = count = at = 0
    block_hold: list[tuple[str, float]] = []  # inline elements that are boilerplate themselves (a button)

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, links, stack[-1][0] if stack else "", path, signs, max((x[1] for x in block_hold), default=0.0)))
            parts = []
        links = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            t = html[at : m.start()]
            if "&" in t:
                t = unescape(t)
            parts.append(t)
            if anchor:
                links += len(t)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in BLOCK:
            if name == "a":
                anchor = 0 if m["end"] else 1
            elif name in ("br", "wbr"):
                parts.append(" " if name == "br" else "")
            elif name in ("button", "label"):
                if m["end"]:
                    close()
                    if block_hold:
                        block_hold.pop()
                else:
                    close()
                    block_hold.append((name, 1.0 if name == "button" else 0.4))
            elif name in ("span", "b", "i", "em", "strong", "font") or m["end"]:
                pass
            continue
        close()
        anchor = 0 if name in ("li", "p", "div") else anchor
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            if stack and stack[-1][0] == "p":
                stack.pop()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in HOLDER:
                    break
            count += 1
            if not m["attrs"].rstrip().endswith("/") or name in BLOCK:
                stack.append((name, _element(name, m["attrs"]), count))
        path, signs = tuple(x[2] for x in stack), tuple(x[1] for x in stack)
    rest = html[at:]
    if rest:
        parts.append(unescape(rest))
        if anchor:
            links += len(rest)
    close()
    return out


def features(blocks: list[Block]) -> list[list[float]]:
    """What the classifier sees of each block of a page."""
    held: dict[int, int] = {}
    for b in blocks:
        for e in b.path:
            held[e] = held.get(e, 0) + len(b.text)
    total = sum(len(b.text) for b in blocks)
    out = []
    for b in blocks:
        always, bad, good, n = b.control, 0.0, 0.0, len(b.path) - 1
        for k, (e, (x, y, z)) in enumerate(zip(b.path, b.signs, strict=True)):
            always = max(always, x * FADE_ALWAYS ** (n - k))
            if y:
                bad = max(bad, y * FADE_BAD ** (n - k) * (1 - (held[e] / total) ** 2))
            if z:
                good = max(good, z * FADE_GOOD ** (n - k))
        words = b.text.count(" ") + 1
        plain = 1 - min(1.0, b.links / len(b.text))
        stop = float(_STOP.search(b.text) is not None)
        tag = b.tag
        out.append([1.0, plain, plain * min(1.0, words / 8), plain * min(1.0, words / 40), stop * plain, float(tag[:1] == "h" and tag[1:].isdigit()), float(tag in ("p", "blockquote", "pre")), float(tag in ("", "li", "td", "th", "option", "dd", "dt")), always, bad, good])
    return out


def fit(rows: list[list[float]], labels: list[int], ridge: float = 3.0, rounds: int = 25) -> list[float]:
    """Logistic weights by Newton's method; ``ridge`` keeps them, and so the costs, small."""
    x, y = np.array(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w.tolist()


@cache
def weights(pages: int = 300) -> tuple[float, ...]:
    """The classifier, fitted on so many generated pages; the same in every run."""
    rows, labels = [], []
    for parts in layouts.pages(pages):
        blocks = blocks_of("".join(h for h, _ in parts))
        own = [label for h, label in parts if label >= 0 for _ in blocks_of(h)]
        rows += features(blocks)
        labels += own
    return tuple(fit(rows, labels))


#: Columns of features(): signs of boilerplate, for certain and other.
_ALWAYS, _BAD = 8, 9


def log_odds(rows: list[list[float]], w: tuple[float, ...]) -> list[float]:
    """The classifier's evidence for content; its size is the block's capacity to the terminal of its side."""
    return [-MOST if x[_ALWAYS] >= 0.5 else max(-MOST, min(MOST, sum(a * b for a, b in zip(x, w, strict=True)))) for x in rows]


def ties(blocks: list[Block], rows: list[list[float]]) -> list[tuple[int, int, float]]:
    """Edges of neighbours in the page and of next children of one element, the weaker the more the signs around them differ."""
    sign = [min(1.0, max(x[_ALWAYS], x[_BAD])) for x in rows]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}

    def tie(i: int, k: int, strength: float) -> None:
        if (strength := strength * (1 - abs(sign[i] - sign[k]))) > 0:
            edges.append((i, k, strength))

    for k, b in enumerate(blocks):
        if k:
            p, q = blocks[k - 1].path, b.path
            same = 0
            for x, y in zip(p, q, strict=False):
                if x != y:
                    break
                same += 1
            tie(k - 1, k, NEXT / max(1, len(p) + len(q) - 2 * same))
        parent = b.path[-2] if len(b.path) > 1 else 0
        before = last.get(parent)
        if before is not None and before != k - 1:
            tie(before, k, SIBLING)
        last[parent] = k
    return edges


def min_cut(good: list[float], bad: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the content side of a minimum cut."""
    n = len(good)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        near[i].append((j, w))
        near[j].append((i, w))
    lean = [g - b for g, b in zip(good, bad, strict=True)]
    pull = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(lean[i]) < pull[i] or lean[i] == 0:
            continue
        label[i] = lean[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                lean[j] += w if label[i] else -w
                pull[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _max_flow(rest, lean, near, label)
    return [bool(x) for x in label]


def _max_flow(rest: list[int], lean: list[float], near: list[list[tuple[int, float]]], label: list) -> None:
    """Label the undecided blocks: shortest augmenting paths in levels over terminals and ties."""
    number = {i: k + 2 for k, i in enumerate(rest)}
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def add(a: int, b: int, x: float, y: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(x)
        out[b].append(len(to))
        to.append(a)
        cap.append(y)

    for i in rest:
        add(0, number[i], lean[i], 0.0) if lean[i] > 0 else add(number[i], 1, -lean[i], 0.0)
        for j, w in near[i]:
            if j in number and j > i:
                add(number[i], number[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * len(out)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[1] < 0:
            break
        step = [0] * len(out)
        path: list[int] = []
        a = 0
        while True:
            if a == 1:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while step[a] < len(out[a]):
                e = out[a][step[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                step[a] += 1
            if step[a] < len(out[a]):
                path.append(out[a][step[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                step[a] += 1
            else:
                break
    for i in rest:
        label[i] = level[number[i]] >= 0


def content(blocks: list[Block], w: tuple[float, ...]) -> list[bool]:
    """True for the blocks on the content side of the page's minimum cut."""
    rows = features(blocks)
    z = log_odds(rows, w)
    return min_cut([max(x, 0.0) for x in z], [max(-x, 0.0) for x in z], ties(blocks, rows))


def main_text(html: str | None, w: tuple[float, ...] | None = None) -> str:
    blocks = blocks_of(html) if html else []
    return "\n".join(b.text for b, k in zip(blocks, content(blocks, w or weights()), strict=True) if k) if blocks else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text (main blocks joined by a line end) and n_chars (its code points)."""
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).cast("string").alias("__html"))

    w = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x, w) for x in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return base.mapInArrow(run, f"`{id_col}` {base.schema['__id'].dataType.simpleString()}, `{url_col}` {base.schema['__url'].dataType.simpleString()}, text string, n_chars long")
