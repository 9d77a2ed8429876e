"""HTML extraction (operator 5) by wrappers: union-free regular expressions over tags.

Some pages of a host are aligned one after another.  Where their element streams differ,
the wrapper gets a text slot, an optional part or a repeated group; what stays the same
text on every page of the host, sampled or not, is template.  Every page of the host is
then matched against the expression, and what its slots and texts take in is the article
or not.  What no sampled page had is judged as in a wrapper of that page alone.  Nothing
recurses, and sequences too long for a table of their common parts are aligned at what is
unique in both.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, small, table
from .words import chunks

#: Pages of a host that its wrapper is made from, one for each bucket of the id's hash.
SAMPLE = 8
#: Wrappers that are broadcast have at most so many rows and bytes in all.
MOST_HOSTS, MOST_BYTES = 2000, 16 << 20

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|([!?][^>]*+>?)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile("[a-z]+")
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio canvas".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open p, and what an element ends of its own kind, up to which element.
_ENDS_P = _BLOCKS - set("body button caption dd dt head html legend li noscript object optgroup option select svg tbody td template tfoot th thead tr video audio canvas".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements, roles and words of class or id that are never the article.
_NEVER = set("aside audio button canvas dialog fieldset footer form head iframe menu nav noembed noframes noscript object option optgroup script search select style svg template textarea title video".split())
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORDS = set(
    "ad ads adv alert aside breadcrumb breadcrumbs consent copyright disclaimer discussion disqus feedback form gdpr hidden legal login masthead modal notice notices notification overlay pager pagination popup rail recommended related replies reply respond responses search share sharing side signup social subscribe subscription toolbar widget widgets".split()
)
_STARTS, _TAILS = ("advert", "comment", "cookie", "newsletter", "promo", "sponsor"), ("banner", "footer", "menu", "menus", "nav", "navbar", "navigation", "sidebar")
#: Words of class or id of what holds the article where no element says so.
_CONTENT = set("article content entry main post story".split())


@dataclass
class Node:
    label: str
    tag: str
    boiler: bool = False
    #: A header, of which only headings can be part of an article.
    header: bool = False
    #: 3 for an article, 2 for a main element, 1 for a class that says so, else 0.
    main: int = 0
    kids: list = field(default_factory=list)


def _open(tag: str, attributes: str) -> Node:
    """The label of an element has its words of class, and whether it can be the article or never is."""
    main = 3 if tag == "article" else 2 if tag == "main" else 0
    if not attributes.strip(" />\t\n\r\f"):
        return Node(tag, tag, tag in _NEVER, tag == "header", main)
    have = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes.rstrip(">"))}
    words = [w for k in ("class", "id") for w in _WORD.findall(have.get(k, "").lower())]
    role = have.get("role", "").lower()
    hidden = "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", "").lower()
    label = ".".join([tag, *words]) + (f"@{role}" if role else "") + ("!" if hidden else "")
    boiler = tag in _NEVER or role in _ROLES or hidden
    if tag not in ("html", "body", "main"):
        boiler = boiler or bool(_WORDS.intersection(words)) or any(w.startswith(_STARTS) or w.endswith(_TAILS) for w in words)
        main = max(main, 3 if role == "article" or have.get("itemprop") == "articleBody" else 2 if role == "main" else int(bool(_CONTENT.intersection(words)) and tag in ("div", "section", "td")))
    return Node(label, tag, boiler, tag == "header" or "header" in words and tag in ("div", "section"), main)


def parse(html: str) -> Node:
    """A tree of block elements, all closed; the text between two block tags is one piece, white space folded."""
    root = Node("", "")
    stack, text, at, n = [root], [], 0, len(html)
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        if text:
            if piece := " ".join(unescape("".join(text)).split()):
                stack[-1].kids.append(piece)
            text.clear()

    def close(i: int) -> None:
        """Close the i-th open element and all within it."""
        open_tags.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def innermost(tags: set[str], until: set[str]) -> int:
        """The place of the innermost open element of these tags that is in none of the others; 0 if there is none."""
        if any(open_tags[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if stack[i].tag in until:
                    break
        return 0

    while at < n:
        m = _TAG.search(html, at)
        text.append(html[at : m.start() if m else n])
        if not m:
            break
        at, tag = m.end(), (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            if tag in _BLOCKS:
                flush()
                if i := innermost({tag}, set()):
                    close(i)
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = end.end() if end else n
            at = html.find(">", at) + 1 or n
            continue
        if tag == "br":
            text.append(" ")
        if tag not in _BLOCKS:
            continue
        flush()
        if tag in _ENDS_P and (i := innermost({"p"}, {"button", "td", "th", "table"})):
            close(i)
        if tag in _ENDS:
            same, until = _ENDS[tag]
            while i := innermost(same, until):
                close(i)
        if tag in _VOID:
            continue
        node = _open(tag, m[4])
        stack[-1].kids.append(node)
        if not m[4].endswith("/>") or tag not in ("svg", "object"):
            stack.append(node)
            open_tags[tag] += 1
    flush()
    return root


@dataclass
class Item:
    """Part of a wrapper: an element, a text (``text`` None: a slot), or a group of parts (label '(')."""

    label: str
    kids: list = field(default_factory=list)
    text: str | None = None
    optional: bool = False
    repeated: bool = False
    boiler: bool = False
    header: bool = False
    main: int = 0
    tag: str = ""
    size: int = 0
    #: A bit for each sampled page that a text was seen in.
    pages: int = 0

    @property
    def name(self) -> str:
        return "(" + " ".join(x.name for x in self.kids) if self.label == "(" else self.label

    def __str__(self) -> str:
        out: list[str] = []
        todo: list[Item | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            mark = "*" if x.optional and x.repeated else "?" if x.optional else "+" if x.repeated else ""
            if x.label == "#":
                out.append(("#" if x.text is None else repr(x.text)) + mark)
            elif x.label == "(":
                todo += [")" + mark, *[y for kid in reversed(x.kids) for y in (kid, " ")][:-1], "("]
            else:
                todo += ["</>" + mark, *reversed(x.kids), f"<{x.label}>"]
        return "".join(out)


#: Merges that wait for those before them; in order, so the parts of what is merged are known by then.
Later = deque[tuple[Item, Item, Item]]


def _settle(later: Later) -> None:
    while later:
        made, a, b = later.popleft()
        made.kids = _align(a.kids, b.kids, later)


def _of_page(root: Node, bit: int = 1) -> Item:
    """A page as a wrapper of itself alone."""

    def shell(node: Node) -> Item:
        return Item(node.label, boiler=node.boiler, header=node.header, main=node.main, tag=node.tag)

    top, made = shell(root), []
    todo = [(root, top)]
    while todo:
        node, item = todo.pop()
        made.append(item)
        for kid in node.kids:
            if isinstance(kid, str):
                item.kids.append(Item("#", text=kid, size=len(kid), pages=bit))
            else:
                item.kids.append(shell(kid))
                todo.append((kid, item.kids[-1]))
    later: Later = deque()
    for item in reversed(made):  # what is within an element is folded before it
        item.kids = _fold(item.kids, later)
        _settle(later)
    return top


def _merge(a: Item, b: Item, later: Later) -> Item:
    """The least wrapper of both: equal labels, different texts become a slot.  Its parts are merged later."""
    made = Item(a.label, [], a.text if a.text == b.text else None, a.optional or b.optional, a.repeated or b.repeated, a.boiler, a.header, a.main, a.tag, max(a.size, b.size), a.pages | b.pages)
    if a.label != "#":
        later.append((made, a, b))
    return made


def _fold(items: list[Item], later: Later) -> list[Item]:
    """Make sequences that follow themselves, of up to four parts, repeated groups."""
    for period in range(1, 5):
        names = [x.name for x in items]
        out: list[Item] = []
        i = 0
        while i < len(items):
            own, j = names[i : i + period], i + period
            block = items[i:j]
            while len(own) == period and own != ["#"] and names[j : j + period] == own:
                block = [_merge(x, y, later) for x, y in zip(block, items[j : j + period])]
                j += period
            if j == i + period:
                out.append(items[i])
                i += 1
                continue
            if period == 1:
                block[0].repeated = True
                out += block
            else:
                out.append(Item("(", block, repeated=True))
            i = j
        items = out
    return items


def _grouped(items: list[Item], groups: list[Item]) -> list[Item]:
    """A single run of what is a repeated group in the other page becomes one, too."""
    wanted = {tuple(x.name for x in g.kids) for g in groups}
    if not wanted:
        return items
    names, sizes, out, i = [x.name for x in items], sorted({len(x) for x in wanted}, reverse=True), [], 0
    while i < len(items):
        n = next((n for n in sizes if tuple(names[i : i + n]) in wanted), 0)
        out.append(Item("(", items[i : i + n]) if n else items[i])
        i += n or 1
    return out


#: Cells of a table for a longest common subsequence; longer sequences are first cut at what is unique in both.
CELLS = 1 << 18


def _matches(p: list[str], q: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence, a longest one where it is short work; n log n otherwise."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and p[a] == q[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and p[b - 1] == q[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= CELLS:
            out += _longest(p, q, a, b, c, d)
            continue
        once = {x for x, n in Counter(p[a:b]).items() if n == 1} & {x for x, n in Counter(q[c:d]).items() if n == 1}
        at = {q[j]: j for j in range(c, d) if q[j] in once}
        cuts = _rising([(i, at[p[i]]) for i in range(a, b) if p[i] in once])
        if cuts:
            edges = [(a - 1, c - 1), *cuts, (b, d)]
            out += cuts
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:])]
        else:
            out += _nearest(p, q, a, b, c, d)
    return sorted(out)


def _longest(p: list[str], q: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    best = [[0] * (d - c + 1) for _ in range(b - a + 1)]
    for i in range(b - a - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(d - c - 1, -1, -1):
            row[j] = below[j + 1] + 1 if p[a + i] == q[c + j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < b - a and j < d - c:
        if p[a + i] == q[c + j]:
            out.append((a + i, c + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the pairs that rises in both places (they do in the first)."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before[k] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _nearest(p: list[str], q: list[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Where the sequences part, skip as little as possible of one of them."""
    places: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for own, seq, lo, hi in ((places[0], p, a, b), (places[1], q, c, d)):
        for i in range(lo, hi):
            own.setdefault(seq[i], []).append(i)

    def ahead(own: dict[str, list[int]], name: str, at: int) -> int:
        found = own.get(name, ())
        k = bisect_left(found, at)
        return found[k] - at if k < len(found) else len(p) + len(q)

    out = []
    while a < b and c < d:
        if p[a] == q[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
            continue
        one, two = ahead(places[0], q[c], a), ahead(places[1], p[a], c)
        if one == two == len(p) + len(q):
            a, c = a + 1, c + 1
        elif one <= two:
            a += one
        else:
            c += two
    return out


def _align(a: list[Item], b: list[Item], later: Later) -> list[Item]:
    """A common subsequence by names; what only one has is optional."""
    p, q = [x.name for x in a], [x.name for x in b]
    if p == q:
        return [_merge(x, y, later) for x, y in zip(a, b)]
    a, b = _grouped(a, [x for x in b if x.label == "("]), _grouped(b, [x for x in a if x.label == "("])
    p, q = [x.name for x in a], [x.name for x in b]
    out: list[Item] = []
    i = j = 0
    for k, m in [*_matches(p, q), (len(a), len(b))]:
        for x in [*a[i:k], *b[j:m]]:
            x.optional = True
            out.append(x)
        if k < len(a):
            out.append(_merge(a[k], b[m], later))
        i, j = k + 1, m + 1
    return _fold(out, later)


def infer(pages: list[str]) -> Item:
    """The wrapper of some pages, each aligned with the wrapper of those before it."""
    wrapper: Item | None = None
    later: Later = deque()
    for i, html in enumerate(pages):
        page = _of_page(parse(html), 1 << i)
        wrapper = page if wrapper is None else _merge(wrapper, page, later)
        _settle(later)
    return wrapper or Item("")


#: What becomes of a text of a wrapper: left out, kept, or (from here on) left out unless a page of the host lacks it.
OUT, IN, CLAIM = 0, 1, 2


def _decide(wrapper: Item, pages: int) -> tuple[dict[int, int], list[tuple[int, str]]]:
    """For each text of the wrapper (by ``id``) whether it belongs to the article, and the claims (path, digest).

    Paths are numbered as ``Wrapper`` numbers them, in page order.

    That is what lies in the article with most text, else in the main element, else in
    the innermost element of such a class that has nearly all the text of any; without
    one, slots and texts that not all ``pages`` have: what all have may be the template,
    if the other pages of the host have it, too.  Elements that never are part of an
    article are left out, and of a header within the article only headings stay.
    """
    paths: dict[tuple[int, str], int] = {}
    every: list[tuple[Item, Item | None, int, int]] = []  # item, the element it is in, path, depth
    texts: list[tuple[Item, int, Item, bool]] = []  # item, path, the element it is in, clean
    holders: list[tuple[Item, int]] = []
    # By element: within what is never an article, within a header, within a possible article.
    state = {id(wrapper): (wrapper.boiler, wrapper.header, bool(wrapper.main))}
    todo: list[tuple[Item, Item, int, int]] = [(kid, wrapper, 0, 0) for kid in reversed(wrapper.kids)]
    weight = {id(wrapper): 0}
    while todo:
        item, above, path, depth = todo.pop()
        boiler, header, main = state[id(above)]
        if item.label == "#":
            texts.append((item, path, above, not boiler and (not header or main and above.tag in _HEADINGS)))
            continue
        if item.label == "(":
            todo += [(kid, above, path, depth) for kid in reversed(item.kids)]
            continue
        state[id(item)] = (boiler or item.boiler, header or item.header, main or bool(item.main))
        weight[id(item)] = 0
        every.append((item, above, path, depth))
        if item.main and not (boiler or item.boiler):
            holders.append((item, depth))
        own = paths.setdefault((path, item.label), len(paths) + 1)
        todo += [(kid, item, own, depth + 1) for kid in reversed(item.kids)]
    for item, _, above, clean in texts:
        weight[id(above)] += item.size if clean else 0
    for item, above, _, _ in reversed(every):
        weight[id(above)] += weight[id(item)]
    top = None
    for tier in (3, 2, 1):
        if own := [(x, depth) for x, depth in holders if x.main == tier and (tier > 1 or weight[id(x)])]:
            most = max(weight[id(x)] for x, _ in own)
            top = max((x for x in own if weight[id(x[0])] >= (most if tier > 1 else 0.8 * most)), key=lambda x: x[1])[0]
            break
    inside = {id(wrapper): top is wrapper}
    for item, above, _, _ in every:
        inside[id(item)] = inside[id(above)] or item is top
    seen: dict[tuple[int, str | None], int] = {}
    for item, path, _, _ in texts:
        seen[path, item.text] = seen.get((path, item.text), 0) | item.pages
    out: dict[int, int] = {}
    claims: dict[tuple[int, str], int] = {}
    for item, path, above, clean in texts:
        if not clean or top is not None:
            out[id(item)] = IN if clean and inside[id(above)] else OUT
        elif item.text is None or pages < 2 or seen[path, item.text] != (1 << pages) - 1:
            out[id(item)] = IN
        else:
            out[id(item)] = CLAIM + claims.setdefault((path, _digest(item.text)), len(claims))
    return out, list(claims)


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


class Wrapper:
    """A wrapper that pages are cut by: a union-free regular expression, and what becomes of each of its texts."""

    def __init__(self, spec: dict):
        self.spec = spec
        labels, above, marks, self.kind = spec["labels"], spec["above"], spec["marks"], spec["kind"]
        #: For each element, the sequence of its parts as (label, repeated, number, begin and end of the innermost repeated group, optional), groups laid open.
        self.parts: list[list[tuple[str, bool, int, int, int, bool]]] = [[] for _ in labels]
        self.places: list[dict[str, list[int]]] = [{} for _ in labels]
        self.paths: dict[tuple[int, str], int] = {}
        self.by_path: dict[int, bool] = {}
        path, element, group, optional = [0] * len(labels), [0] * len(labels), [None] * len(labels), [False] * len(labels)
        bounds: dict[int, list[int]] = {}
        for i in range(1, len(labels)):
            up = above[i]
            inside = labels[up] == "("
            element[i] = own = element[up] if inside else up
            group[i] = up if inside and marks[up] & 2 else group[up] if inside else None
            path[i] = path[own]
            optional[i] = bool(marks[i] & 1) or inside and optional[up]
            if labels[i] == "(":
                bounds[i] = [len(self.parts[own]), 0]
                continue
            self.places[own].setdefault(labels[i], []).append(len(self.parts[own]))
            self.parts[own].append((labels[i], bool(marks[i] & 2), i, group[i], optional[i]))
            g = up
            while labels[g] == "(":
                bounds[g][1] = len(self.parts[own])
                g = above[g]
            if labels[i] == "#":
                self.by_path[path[own]] = self.by_path.get(path[own], False) or self.kind[i] == IN
            else:
                path[i] = self.paths.setdefault((path[own], labels[i]), len(self.paths) + 1)
        for seq in self.parts:
            seq[:] = [(a, b, i, *(bounds[g] if g is not None else (0, 0)), o) for a, b, i, g, o in seq]

    @staticmethod
    def of(wrapper: Item, pages: int) -> Wrapper:
        kinds, claims = _decide(wrapper, pages)
        labels, above, marks, kind = [], [], [], []
        todo = [(wrapper, -1)]
        while todo:
            item, up = todo.pop()
            todo += [(kid, len(labels)) for kid in reversed(item.kids)]
            labels.append(item.label)
            above.append(up)
            marks.append(item.optional + 2 * item.repeated)
            kind.append(kinds.get(id(item), OUT))
        return Wrapper({"labels": labels, "above": above, "marks": marks, "kind": kind, "claims": claims})

    @staticmethod
    def learn(pages: list[str]) -> Wrapper:
        return Wrapper.of(infer(pages), len(pages))

    def freed(self, claims: list[int]) -> Wrapper:
        """With the texts of these claims kept: they are no template."""
        gone = {CLAIM + x for x in claims}
        return Wrapper(self.spec | {"kind": [IN if x in gone else x for x in self.kind]})

    def match(self, root: Node) -> Iterator[tuple[str, int | None, int | None]]:
        """The texts of a page in order, each with the wrapper's text that it is an instance of and its path; None where the wrapper has none.

        An element's parts are matched to the expression from left to right: a part goes to
        the repeated one or group that it continues, else to the next of its name, as
        anything may be left out.
        """
        todo: list[tuple[Node | str, int | None, int | None]] = [(root, 0, 0)]
        while todo:
            node, item, path = todo.pop()
            if isinstance(node, str):
                yield node, item, path
                continue
            at, found = -1, []
            seq, places = (self.parts[item], self.places[item]) if item is not None else ((), {})
            names = ["#" if isinstance(kid, str) else kid.label for kid in node.kids]
            for kid, name, after in zip(node.kids, names, [*names[1:], None]):
                to = self._next(seq, places.get(name, ()), name, at, after)
                at = at if to is None else to
                below = path if name == "#" else self.paths.get((path, name)) if path is not None else None
                found.append((kid, None if to is None else seq[to][2], below))
            todo += reversed(found)

    @classmethod
    def _next(cls, seq, places, name: str, at: int, after: str | None) -> int | None:
        if not places:
            return None
        k = bisect_left(places, at + 1)
        ahead = places[k] if k < len(places) else None
        if at >= 0:
            own, repeated, _, begin, end, _ = seq[at]
            if own == name and repeated:
                return at
            if end and (ahead is None or ahead >= end):
                k = bisect_left(places, begin)
                # Another turn of the group, unless what follows only fits what is behind it.
                if k < len(places) and places[k] < end and (ahead is None or cls._goes_on(seq, places[k], after) or not cls._goes_on(seq, ahead, after)):
                    return places[k]
        return ahead

    @staticmethod
    def _goes_on(seq, at: int, name: str | None) -> bool:
        """Whether the expression allows a part of this name, or its end, right after a place."""
        own, repeated, _, begin, end, _ = seq[at]
        if own == name and repeated:
            return True
        to = at + 1
        while to < len(seq) and to - at < 8:
            if to == end and seq[begin][0] == name or seq[to][0] == name:
                return True
            if not seq[to][5] or to == end and name is None:
                return False
            to += 1
        return name is None if to == len(seq) else False

    def blocks(self, root: Node) -> list[str]:
        """The article's blocks.  A text that is an instance of none is judged by others at its path, or else by the page alone."""
        out, alone = [], None
        for nth, (text, item, path) in enumerate(self.match(root)):
            if item is not None:
                keep = self.kind[item] == IN
            elif path in self.by_path:
                keep = self.by_path[path]
            else:
                if alone is None:
                    own = Wrapper.of(_of_page(root), 1)
                    alone = [own.kind[i] == IN if i is not None else own.by_path.get(p, False) for _, i, p in own.match(root)]
                keep = alone[nth]
            if keep:
                out.append(text)
        return out


def cut(html: str, wrapper: Wrapper | None = None) -> str:
    """The article of a page: its blocks joined by an empty line.

    A page in which the wrapper's article has no text is judged by itself.
    """
    root = parse(html)
    found = wrapper.blocks(root) if wrapper else []
    return "\n\n".join(found or Wrapper.of(_of_page(root), 1).blocks(root))


@lru_cache(maxsize=1024)
def _read(spec: str | None) -> Wrapper | None:
    return Wrapper(json.loads(spec)) if spec else None


def _has_text(root: Node) -> bool:
    todo: list[Node] = [root]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str):
                return True
            todo.append(kid)
    return False


def host(url: Column) -> Column:
    """The host of a URL in lower case; '' for a null URL or none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``host, pattern, wrapper``: each host's wrapper as text, and as JSON what pages are cut by.

    Made from at most ``sample`` pages of a host, of each bucket of page_id's hash the
    page of the smallest hash; the minimum is taken before the shuffle, so a host of any
    size is no burden.  A text that is template by these is looked for in all pages of
    the host; if one with any text has not this one at that path, it is the article's.
    """
    hashed = pages.select(host(F.col("url")).alias("host"), F.xxhash64("page_id", "html").alias("h"), "html").where(F.col("html").isNotNull())
    picks = hashed.groupBy("host", F.pmod("h", F.lit(sample)).alias("b")).agg(F.min("h").alias("h"))
    picks = checkpointed(picks.select(F.col("host").alias("_host"), F.col("h").alias("_h")))
    few = small(picks)
    some = hashed.join(few(picks), (F.col("host") == F.col("_host")) & (F.col("h") == F.col("_h"))).select("host", "h", "html").dropDuplicates(["host", "h"])

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("h")
        texts = [t for t in rows["html"].to_pylist() if _has_text(parse(t))]
        found = infer(texts)
        made = Wrapper.of(found, len(texts)).spec
        return pa.table({"host": [rows["host"][0].as_py()], "pattern": [str(found)], "wrapper": [json.dumps(made)], "claims": pa.array([bool(made["claims"])])})

    made = checkpointed(some.groupBy("host").applyInArrow(run, "host string, pattern string, wrapper string, claims boolean"))
    claims = made.where("claims").select(F.col("host").alias("_host"), "wrapper")
    if claims.isEmpty():
        return made.drop("claims")
    asked = _with_wrapper(hashed.select("host", "html"), claims, "inner")

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html", 4 << 20):
                found: dict[str, set[int]] = {}
                for name, page, spec in zip(part["host"].to_pylist(), part["html"].to_pylist(), part["wrapper"].to_pylist()):
                    wrapper, gone = _read(spec), found.setdefault(name, set())
                    claims = wrapper.spec["claims"]
                    if len(gone) < len(claims):
                        have: dict[int | None, set[str]] = {}
                        for text, _, path in wrapper.match(parse(page)):
                            have.setdefault(path, set()).add(text)
                        if have:
                            digests = {path: set(map(_digest, have.get(path, ()))) for path in {path for path, _ in claims}}
                            gone.update(i for i, (path, digest) in enumerate(claims) if digest not in digests[path])
                rows = [(name, i) for name, gone in found.items() for i in sorted(gone)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["_host", "claim"])

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [json.dumps(_read(old).freed(own).spec) if own else old for old, own in zip(batch["wrapper"].to_pylist(), batch["found"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["host"], batch["pattern"], pa.array(known, pa.string())], ["host", "pattern", "wrapper"])

    gone = asked.mapInArrow(differing, "_host string, claim int").groupBy("_host").agg(F.collect_set("claim").alias("found"))
    return made.join(gone, F.col("host") == F.col("_host"), "left").select("host", "pattern", "wrapper", "found").mapInArrow(freed, "host string, pattern string, wrapper string")


def _with_wrapper(pages: DataFrame, made: DataFrame, how: str) -> DataFrame:
    """Pages (host, ...) with their host's wrapper (made: _host, wrapper); broadcast if all wrappers are small enough."""
    rows, size = made.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()
    own = F.broadcast(made) if rows <= MOST_HOSTS and size <= MOST_BYTES else made
    return pages.join(own, F.col("host") == F.col("_host"), how).drop("_host")


def extract(pages: DataFrame, sample: int = SAMPLE, out: str = "text") -> DataFrame:
    """``pages`` (page_id, url, html) with the article's text in ``out``.

    Each page is matched against its host's wrapper, which says of each of its slots,
    texts and groups whether it is the article's.  Character references are decoded, white
    space within a block is one space, blocks stand in page order with an empty line
    between.  Null or empty html and pages without an article give ''.  Pages without a
    host share one wrapper.  Pages may be as deep or wide as they like.  Repeated rows each
    get their text; other columns pass through.
    """
    names = [c for c in pages.columns if c != out]
    made = checkpointed(wrappers(pages, sample).select(F.concat(F.lit("//"), "host").alias("_host"), "wrapper"))
    joined = pages.select(F.struct(*names).alias("_row"), F.col("html").alias("_html"), F.concat(F.lit("//"), host(F.col("url"))).alias("host"))
    joined = _with_wrapper(joined, made, "left").select("_row", "_html", F.col("wrapper").alias("_wrapper"))
    schema = T.StructType([T.StructField("_row", joined.schema["_row"].dataType), T.StructField("_out", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_html", 4 << 20):
                texts = [cut(h.as_py(), _read(w.as_py())) if h.is_valid else "" for h, w in zip(part["_html"], part["_wrapper"])]
                yield pa.RecordBatch.from_arrays([part["_row"], pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema).select(*(F.col("_row")[c].alias(c) for c in names), F.col("_out").alias(out))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
