"""A forgiving HTML parser to small trees, and simple tree matching between them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np

#: Fixed values from the HTML standard: elements without content, with raw text, that end an open p, and that flow inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math noscript object q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
MAX_DEPTH = 120
#: Sibling lists of more pairs than SIBLING_PAIRS are matched row by row with numpy, to the same end. Of their table every so many-th
#: row is kept, and no more weights than HELD_WEIGHTS.
SIBLING_PAIRS, HELD_WEIGHTS = 1 << 12, 1 << 22

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)


class Node:
    """An element. text: (what stands directly in it, in a link or not), in order among its children."""

    __slots__ = ("tag", "names", "children", "pieces", "parent", "sig", "size", "number")

    def __init__(self, tag: str, names: str, parent: Node | None) -> None:
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list[Node] = []
        self.pieces: list[str | Node] = []
        self.sig = self.size = self.number = 0


def _raw_end(text: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
    return m.start() if m else len(text)


def tokens(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag, name empty for comments and declarations; a caller may send the place to go on from.

    Linear: a tag ends at the first > outside quotes; once a tag has no such end, quotes on the page aren't paired
    and every later tag ends at its first >. Without any > after it, what looks like a tag is text."""
    at, quotes, size = text.find("<"), True, len(text)
    last = text.rfind(">")
    while 0 <= at < size:
        name, rest, end = "", "", -1
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            end = size if end < 0 else end + 3
        elif text.startswith(("<!", "<?"), at):
            end = text.find(">", at) + 1 or size
        elif (m := _NAME.match(text, at)) and m.end() <= last:
            body = _ATTRIBUTES.match(text, m.end()) if quotes else None
            quotes = body is not None
            end = body.end() if body else text.find(">", m.end()) + 1
            name, rest = m[1], text[m.end() : end - 1]
        elif m:
            return
        if end < 0:
            at = text.find("<", at + 1)
            continue
        told = yield at, end, ("/" if name and text[at + 1] == "/" else "") + name, rest
        at = text.find("<", end if told is None else told)


def parse(text: str) -> Node:
    """The tree of a page. Raw elements are kept without content; what is nested deeper than MAX_DEPTH is lifted to it."""
    root = Node("#root", "", None)
    stack, at = [root], 0

    def add(piece: str) -> None:
        if piece:
            stack[-1].pieces.append(html.unescape(piece))

    scan, told = tokens(text), None
    while True:
        try:
            start, end, name, rest = scan.send(told)
        except StopIteration:
            break
        add(text[at:start])
        at, told = end, None
        if not name:
            continue
        tag = name.lstrip("/").lower()
        if name[0] == "/":
            if tag == "br":
                stack[-1].pieces.append(" ")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("td", "th", "table", "article", "main", "body") and tag in INLINE:
                    break  # a stray inline end tag doesn't close its surroundings
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSED_BY:
            ends, scope = CLOSED_BY[tag], SCOPES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        node = Node(tag, " ".join(v.strip("\"'").lower() for _, v in _NAMED.findall(rest)) if "=" in rest else "", stack[-1])
        stack[-1].children.append(node)
        stack[-1].pieces.append(node)
        if tag in RAW:
            at = told = _raw_end(text, tag, at) if not rest.endswith("/") else at
        elif tag not in VOID and not (rest.endswith("/") and tag not in INLINE) and len(stack) < MAX_DEPTH:
            stack.append(node)
    add(text[at:])
    return root


def numbered(root: Node) -> list[Node]:
    """All nodes in page order; sets each one's number, size and structure signature."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(order)
        order.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(order):
        node.size = 1 + sum(c.size for c in node.children)
        node.sig = hash((node.tag, node.names, *(c.sig for c in node.children)))
    return order


def _same(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.names == b.names


def _common(xs: list[Node], ys: list[Node]) -> int:
    """Length of the longest common subsequence of leaves; a bit of an integer for each of ys."""
    spots: dict[int, int] = {}
    for k, y in enumerate(ys):
        spots[y.sig] = spots.get(y.sig, 0) | 1 << k
    every = (1 << len(ys)) - 1
    left = every
    for x in xs:
        met = left & spots.get(x.sig, 0)
        left = (left + met | left - met) & every
    return len(ys) - left.bit_count()


class Matcher:
    """Simple tree matching: the largest order-preserving matching of two trees in which matched nodes have
    matched parents and equal labels. Children that are alike in structure at either end are matched at once,
    which never costs anything, and weights are kept by pairs of structures, which repeat."""

    def __init__(self, keep: int = 100_000) -> None:
        self.known: dict[tuple[int, int], int] = {}
        self.keep = keep

    def weight(self, a: Node, b: Node) -> int:
        if not _same(a, b):
            return 0
        if a.sig == b.sig:
            return a.size
        key = (a.sig, b.sig)
        if key not in self.known:
            if len(self.known) >= self.keep:
                self.known.clear()
            if a.size == 1 + len(a.children) and b.size == 1 + len(b.children):
                self.known[key] = 1 + _common(a.children, b.children)
            else:
                self.known[key] = 1 + sum(self.weight(x, y) for x, y in self._pairs(a.children, b.children))
        return self.known[key]

    def _pairs(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """Which children to match."""
        pairs, lo, hi_x, hi_y = [], 0, len(xs), len(ys)
        while lo < hi_x and lo < hi_y and xs[lo].sig == ys[lo].sig:
            pairs.append((xs[lo], ys[lo]))
            lo += 1
        tail = []
        while lo < hi_x and lo < hi_y and xs[hi_x - 1].sig == ys[hi_y - 1].sig:
            hi_x, hi_y = hi_x - 1, hi_y - 1
            tail.append((xs[hi_x], ys[hi_y]))
        xs, ys = xs[lo:hi_x], ys[lo:hi_y]
        if len(xs) * len(ys) > SIBLING_PAIRS:
            pairs += self._middle(xs, ys)
        elif xs and ys:
            weights = [[self.weight(x, y) for y in ys] for x in xs]
            best = [[0] * (len(ys) + 1)]
            for i in range(len(xs)):
                above, row = best[-1], [0]
                for j, w in enumerate(weights[i]):
                    row.append(max(above[j + 1], row[j], above[j] + w if w else 0))
                best.append(row)
            i, j, middle = len(xs), len(ys), []
            while i and j:
                if weights[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weights[i - 1][j - 1]:
                    middle.append((xs[i - 1], ys[j - 1]))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
            pairs += reversed(middle)
        return pairs + tail[::-1]

    def _middle(self, xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        """What ``_pairs`` finds for long lists: siblings alike in structure are weighed once, a row of the table is made
        at once, and rows between kept ones are made again on the way back, so space grows with one list's length."""
        kinds = {y.sig: y for y in reversed(ys)}
        place = {sig: k for k, sig in enumerate(kinds)}
        column, held = np.array([place[y.sig] for y in ys]), {}

        def weights(x: Node) -> np.ndarray:
            if x.sig not in held:
                if len(held) * len(kinds) >= HELD_WEIGHTS:
                    held.clear()
                held[x.sig] = np.array([self.weight(x, y) for y in kinds.values()])
            return held[x.sig][column]

        def following(above: np.ndarray, w: np.ndarray) -> np.ndarray:
            row = above.copy()
            np.maximum(row[1:], np.where(w > 0, above[:-1] + w, 0), out=row[1:])
            return np.maximum.accumulate(row)

        step = int(len(xs) ** 0.5) + 1
        row, kept = np.zeros(len(ys) + 1, dtype=np.int64), []
        for i, x in enumerate(xs):
            if i % step == 0:
                kept.append(row)
            row = following(row, weights(x))
        i, j, found = len(xs), len(ys), []
        while kept:
            rows = [kept.pop()]
            first = len(kept) * step
            for x in xs[first:i]:
                rows.append(following(rows[-1], weights(x)))
            while i > first and j:
                above, now, w = rows[i - 1 - first], rows[i - first], weights(xs[i - 1])
                while j:  # as far as the row leads to the left
                    if w[j - 1] and now[j] == above[j - 1] + w[j - 1]:
                        found.append((xs[i - 1], ys[j - 1]))
                        j -= 1
                        break
                    if now[j] == above[j]:
                        break
                    j -= 1
                i -= 1
            i = first
        return found[::-1]

    def align(self, a: Node, b: Node) -> dict[int, int]:
        """Number of each matched node of a to that of b. Both must be numbered."""
        if not _same(a, b):
            return {}
        found, stack = {}, [(a, b)]
        while stack:
            x, y = stack.pop()
            found[x.number] = y.number
            stack += self._pairs(x.children, y.children)
        return found
