"""Operator 7: main text of web pages by wrapper induction.

1. Each host gets one seed page, chosen by size and id. Every page of the host is aligned with the
   seed by simple tree matching: the largest set of node pairs with equal tags that keeps parents
   and the order of siblings.
2. For each node of the seed, grouped sums over the distinct pages of the host tell in how many of
   them the matched node had the very same text, and how much other text stood in it. Nodes that
   hold it on `share` of all these pages are template; others are slots of content. The slot of the
   article is the lowest node that holds two thirds of the varying text of each node around it.
3. A page's text is read from its content roots, in page order: the elements that name themselves
   article or main where they overlap the article's slot, else the slot. Elements that only name
   themselves so lose to a slot apart from them that holds twice their text. Hosts of fewer than
   `least_pages` distinct pages have no slots; their pages are read by names alone, or whole.
4. Elements whose role is navigation, header, footer, sidebar, notice, advertisement, form, comment,
   script or style are left out, and so are the texts that are the template's on this page too: a
   node that is aligned with a template node but reads otherwise stays, and so do the blocks below
   one that goes, each by its own text. A class or id tells a role by its whole name; inside an
   article only names that mean nothing else do. A page without any text but the template's keeps
   it, as on a host that repeats one page.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one line feed. Null and empty pages give an empty text. Very long pages are
read whole, one at a time; lists of siblings are matched in time of the product of their lengths,
vectorised, and in memory of their sum. A null or unusable address belongs to no host and is read by
names alone. Rows that share an id or a text are read one by one. Further columns are ignored. An
empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm._shared import left_join_counted, materialise, maybe_broadcast, slices

# Element names of HTML by how they nest, and names that tell an element's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - frozenset("body html tbody thead tfoot tr td th caption option optgroup dd dt li legend summary figcaption".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select textarea input label menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars aside widget footer foot masthead topbar notice notices cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay share sharing social comment comments commentlist respond disqus reply replies related recommended pagination pager skip toolbar login".split())
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored nav navbar breadcrumb breadcrumbs sidebar sidebars notice notices cookie cookies gdpr newsletter comment comments commentlist disqus pagination pager".split())
PLAIN_NAMES = frozenset("top bottom left right box block list item items wrapper wrap container section area bar site page links link buttons button posts articles stories slot unit panel form icons inner outer".split())
HEAD_NAMES = frozenset("header site-header page-header".split())
CONTENT_NAMES = frozenset("article content main post entry story article-body articlebody post-content entry-content main-content page-content story-body post-body".split())
CONTAINERS = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "dd": ("dl",), "dt": ("dl",), "option": ("select",)}
SIBLINGS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",)}

MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTES = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attributes: str = ""
    children: list = field(default_factory=list)  # nodes and strings, in page order
    mark: int = -1  # the seed's node that it is aligned with
    size: int = 0  # nodes of the subtree; 0 until measure() has run, which sets the next three too
    shape: int = 0  # hash of the subtree's tags
    content: int = 0  # hash of the subtree's tags, attributes and texts
    kids: list | tuple = ()  # the nodes among its children

    @property
    def nodes(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(page: str) -> Node:
    """The tree of a page; whatever is left open is closed by what follows, as browsers do."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("table", "td", "th", "article", "body") and tag not in ("table", "body", "html", "article", "main", "section", "div"):
                    break  # an end tag of something outside does not close these
            continue
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CONTAINERS[tag]:
                    break
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    break
        elif tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.nodes))
    return out


def own_text(node: Node) -> str:
    """A node's text with that of the inline elements in it, but not of blocks below it."""
    out: list[str] = []
    stack: list = [node]
    first = True
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif first or x.tag not in BLOCKS and x.tag not in RAW:
            first = False
            stack.extend(reversed(x.children))
    return SPACE.sub(" ", html.unescape("".join(out))).strip()


def measure(root: Node) -> None:
    """Size, hashes and child nodes of every subtree, from the leaves up."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        if x.children:
            x.kids = x.nodes
            stack.extend(x.kids)
    for x in reversed(order):
        kids = x.kids
        if not kids:
            x.size, x.shape, x.content = 1, hash(x.tag), hash((x.tag, x.attributes, *x.children))
            continue
        size, shapes, contents = 1, [x.tag], [x.tag, x.attributes]
        for c in x.children:
            if isinstance(c, str):
                contents.append(c)
            else:
                size += c.size
                shapes.append(c.shape)
                contents.append(c.content)
        x.size, x.shape, x.content = size, hash(tuple(shapes)), hash(tuple(contents))


_weights: dict[tuple[int, int], int] = {}  # largest matches of recent pairs of shapes


def _trim(left: list[int], right: list[int]) -> tuple[int, int]:
    """How many nodes at the beginning, and at the end, have equal hashes: as no match of such a node is larger, a largest match pairs them."""
    most = min(len(left), len(right))
    head = 0
    while head < most and left[head] == right[head]:
        head += 1
    tail = 0
    while tail < most - head and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    return head, tail


def _best(sizes: list[list[int]], m: int, n: int) -> list[list[int]]:
    """best[i][j]: the largest sum of sizes over pairs in order of the lists from i and from j."""
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        below, row, s = best[i + 1], best[i], sizes[i]
        for j in range(n - 1, -1, -1):
            v = below[j + 1] + s[j] if s[j] else 0
            u = below[j] if below[j] > row[j + 1] else row[j + 1]
            row[j] = v if v > u else u
    return best


class _Grid:
    """Sizes of all pairs of two long lists of nodes, a row at a time: from the pairs of their distinct shapes."""

    def __init__(self, left: list[Node], right: list[Node], size: Callable[[Node, Node], int], alike: int = 0):
        self.alike = alike
        first_l, self.l = self._distinct(left)
        first_r, self.r = self._distinct(right)
        self.table = np.array([[size(p, q) for q in first_r] for p in first_l], np.int64)
        if alike:
            self.tags = [np.array([hash(x.attributes) for x in part], np.int64) for part in (left, right)]
            self.texts = [np.array([x.content for x in part], np.int64) for part in (left, right)]

    @staticmethod
    def _distinct(nodes: list[Node]) -> tuple[list[Node], np.ndarray]:
        place: dict[int, int] = {}
        first: list[Node] = []
        for x in nodes:
            if x.shape not in place:
                place[x.shape] = len(first)
                first.append(x)
        return first, np.array([place[x.shape] for x in nodes], np.int64)

    def row(self, i: int, start: int, end: int) -> np.ndarray:
        out = self.table[self.l[i], self.r[start:end]]
        if self.alike:
            likeness = (self.tags[0][i] == self.tags[1][start:end]) + 2 * (self.texts[0][i] == self.texts[1][start:end])
            out = np.where(out > 0, self.alike * out + likeness, 0)
        return out

    def sums(self, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
        """For each j, the largest sum over pairs in order of the rows with the columns from j0 to j."""
        f = np.zeros(j1 - j0 + 1, np.int64)
        for i in range(i0, i1):
            f[1:] = np.maximum(f[1:], f[:-1] + self.row(i, j0, j1))
            np.maximum.accumulate(f, out=f)
        return f

    def sums_back(self, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
        """For each j, the largest sum over pairs in order of the rows with the columns from j to j1."""
        f = np.zeros(j1 - j0 + 1, np.int64)
        for i in range(i1 - 1, i0 - 1, -1):
            f[:-1] = np.maximum(f[:-1], f[1:] + self.row(i, j0, j1))
            f = np.maximum.accumulate(f[::-1])[::-1]
        return f

    def pairs(self, most: int = 1 << 20) -> list[tuple[int, int]]:
        """The pairs of a largest sum: rows are halved until what is left fits a table of `most` cells."""
        out, todo = [], [(0, len(self.l), 0, len(self.r))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > most:
                mid = (i0 + i1) // 2
                cut = j0 + int(np.argmax(self.sums(i0, mid, j0, j1) + self.sums_back(mid, i1, j0, j1)))
                todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
                continue
            sizes = [self.row(i, j0, j1) for i in range(i0, i1)]
            best = [np.zeros(j1 - j0 + 1, np.int64)]
            for s in reversed(sizes):
                f = best[-1].copy()
                f[:-1] = np.maximum(f[:-1], np.where(s > 0, best[-1][1:] + s, 0))
                best.append(np.maximum.accumulate(f[::-1])[::-1])
            best.reverse()
            i, j = i0, j0
            while i < i1 and j < j1:
                s, here = sizes[i - i0][j - j0], best[i - i0][j - j0]
                if s and here == best[i - i0 + 1][j - j0 + 1] + s:
                    out.append((i, j))
                    i, j = i + 1, j + 1
                elif here == best[i - i0 + 1][j - j0]:
                    i += 1
                else:
                    j += 1
        return out


LONG = 400  # pairs of siblings from which on rows of numbers pay


def _known(p: Node, q: Node) -> int | None:
    """Size of the largest match of two nodes, where it is plain or remembered."""
    if p.tag != q.tag:
        return 0
    if p.shape == q.shape:
        return p.size
    if p.size == 1 or q.size == 1:
        return 1
    return _weights.get((p.shape, q.shape))


def weight(a: Node, b: Node) -> int:
    """Size of the largest match of two measured nodes: one, and the largest sum over pairs of their children in order; 0 for unequal tags."""
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if _known(p, q) is not None:
            todo.pop()
            continue
        left, right = p.kids, q.kids
        head, tail = _trim([x.shape for x in left], [x.shape for x in right])
        fixed = 1 + sum(x.size for x in left[:head]) + sum(x.size for x in left[len(left) - tail :])
        left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        few = list({x.shape: x for x in left}.values()), list({y.shape: y for y in right}.values())
        missing = [(x, y) for x in few[0] for y in few[1] if _known(x, y) is None]
        if missing:
            todo.extend(missing)
            continue
        if len(left) * len(right) > LONG:
            most = int(_Grid(left, right, _known).sums(0, len(left), 0, len(right))[-1])
        else:
            most = _best([[_known(x, y) for y in right] for x in left], len(left), len(right))[0][0]
        _weights[p.shape, q.shape] = fixed + most
        todo.pop()
    return _known(a, b)


def match(a: Node, b: Node) -> int:
    """Simple tree matching of two nodes with equal tags: size of the largest match, and marks.

    Children are paired by the sizes of their own largest matches, so the whole is the largest;
    among equally large ones, pairs of equal content and of equal attributes come first. Nodes of
    b that are matched get the index in `mark` of their partner in a.
    """
    if len(_weights) > 200_000:
        _weights.clear()
    if not a.size:
        measure(a)
    measure(b)
    pairs = [(a, b)]
    total = 0
    while pairs:
        x, y = pairs.pop()
        y.mark = x.mark
        total += 1
        left, right = x.kids, y.kids
        if not left or not right:
            continue
        head, tail = _trim([p.content for p in left], [q.content for q in right])
        if head or tail:
            pairs.extend(zip(left[:head], right[:head], strict=True))
            pairs.extend(zip(left[len(left) - tail :], right[len(right) - tail :], strict=True))
            left, right = left[head : len(left) - tail], right[head : len(right) - tail]
        m, n = len(left), len(right)
        if not m or not n:
            continue
        tags = [p.tag for p in left]
        if len(set(tags)) == m and tags == [q.tag for q in right]:
            pairs.extend(zip(left, right, strict=True))  # no node has another partner
            continue
        unit = 4 * min(m, n)  # above all that equal attributes and contents can add
        if m * n > LONG:
            pairs.extend((left[i], right[j]) for i, j in _Grid(left, right, lambda p, q: weight(p, q), unit).pairs())
            continue
        sizes = [[unit * (_known(p, q) or weight(p, q)) + (p.attributes == q.attributes) + 2 * (p.content == q.content) if p.tag == q.tag else 0 for q in right] for p in left]
        best = _best(sizes, m, n)
        i = j = 0
        while i < m and j < n:
            if sizes[i][j] and best[i][j] == best[i + 1][j + 1] + sizes[i][j]:
                pairs.append((left[i], right[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return total


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTES.finditer(node.attributes)} if node.attributes.strip(" /") else {}


def is_boilerplate(node: Node, inside: bool, names: frozenset | None = None) -> bool:
    """Whether an element's name, role or class tells that it is no part of an article; `inside` an article, a header may hold its headings."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not inside or not any(x.tag in ("h1", "h2", "h3") for x in preorder(node))
    if node.tag in ("html", "body", "article", "main"):
        return False
    a = _attributes(node)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in DROPPED_ROLES:
        return True
    for name in _names(a):
        if name in HEAD_NAMES and not inside or name not in CONTENT_NAMES and _tells_role(name, names or (SURE_NAMES if inside else DROPPED_NAMES)):
            return True
    return False


def _names(attributes: dict[str, str]) -> list[str]:
    """Whole names that an element gives itself by class or id."""
    return NAMES.findall((attributes.get("class", "") + " " + attributes.get("id", "")).lower().replace("_", "-"))


def _tells_role(name: str, roles: frozenset) -> bool:
    """Whether a name is one of a role, or such a one with words that only say where or in what it stands: related-posts, but not related-work."""
    if name in roles:
        return True
    parts = set(name.split("-"))
    return len(parts) > 1 and bool(parts & roles) and parts <= roles | PLAIN_NAMES


def content_roots(root: Node) -> list[Node]:
    """The elements that name themselves the article's, in page order: all outermost ones of the first kind that has text - by tag, role or name - or none.

    If articles lie in a main element, that element stands for them, since a heading or lead may
    stand beside them.
    """
    found: dict[int, list[Node]] = {}
    mains: set[int] = set()  # main elements that articles lie in
    stack: list[tuple[Node, tuple[bool, ...], Node | None]] = [(root, (False, False, False), None)]
    while stack:
        x, within, main = stack.pop()
        if x is not root and is_boilerplate(x, main is not None):
            continue
        a = _attributes(x) if x.attributes else {}
        kind = 0 if x.tag == "article" or a.get("itemprop", "").lower() == "articlebody" else 1 if x.tag == "main" or a.get("role", "").lower() == "main" else 2 if CONTENT_NAMES & set(_names(a)) else None
        if kind is not None and not within[kind]:
            if kind == 1:
                main = x
            if kind or main is None or not blocks(x, {}):
                found.setdefault(kind, []).append(x)
            elif id(main) not in mains:
                mains.add(id(main))
                found.setdefault(0, []).append(main)
            within = tuple(w or k == kind for k, w in enumerate(within))
        if kind == 0:
            continue
        stack.extend((c, within, main) for c in reversed(x.nodes))
    for kind in sorted(found):
        if any(blocks(x, {}) for x in found[kind]):
            return found[kind]
    return []


def body_of(root: Node) -> Node:
    return next((x for x in preorder(root) if x.tag == "body"), root)


def slot_of(nodes: list[Node], mass: dict[int, float]) -> int | None:
    """The seed's node that holds the article: from the top down, the child with two thirds of the varying text of its parent, while there is one.

    mass: how much varying text stood in each node of the numbered seed itself, blocks below it apart.
    """
    below = [mass.get(i, 0.0) for i in range(len(nodes))]
    for i in range(len(nodes) - 1, -1, -1):
        below[i] += sum(below[c.mark] for c in nodes[i].nodes)
    at = nodes[0]
    if not below[0]:
        return None
    while heavy := next((c for c in at.nodes if 3 * below[c.mark] >= 2 * below[at.mark]), None):
        if heavy.tag not in BLOCKS and heavy.tag not in ("html", "body") or heavy.tag == "p":
            break
        at = heavy
    return at.mark if at.tag not in ("#root", "html", "body") else None


def roots_of(tree: Node, slot: int | None) -> list[Node]:
    """Where a page's text stands: its elements that name themselves content, unless the host's slot lies elsewhere and holds twice their text; else the slot, else the body."""
    named = content_roots(tree)
    if slot is None:
        return named or [body_of(tree)]
    held = next((x for x in preorder(tree) if x.mark == slot), None)
    if held is None:
        return named or [body_of(tree)]
    if not named:
        return [held]
    inside = {id(x) for x in preorder(held)}
    if any(id(x) in inside for x in named) or any(x is held for r in named for x in preorder(r)):
        return named
    size = lambda x: sum(map(len, blocks(x, {})))
    return [held] if size(held) > 2 * sum(map(size, named)) else named


def blocks(root: Node, template: dict[int, str]) -> list[str]:
    """Texts of the blocks below a content root, in page order, without boilerplate and without what reads as the template's node does.

    template: the constant text of each template node. A node that holds it loses its own text;
    blocks below are judged by theirs.
    """
    out: list[str] = []
    held: list[str] = []
    names = DROPPED_NAMES if root.tag in ("#root", "html", "body") else SURE_NAMES

    def end() -> None:
        text = SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list = [(root, False)]
    while stack:
        x, mute = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if not mute:
                held.append(x)
        elif x is root or not is_boilerplate(x, True, names):
            block = x.tag in BLOCKS or x is root
            mute = mute and not block or x is not root and x.mark in template and own_text(x) == template[x.mark]
            if x.tag == "br" or x.tag == "wbr":
                held.append(" " if x.tag == "br" else "")
            elif block:
                end()
                stack.append((None, False))
                stack.extend((c, mute) for c in reversed(x.children))
            elif x.tag not in RAW:
                stack.extend((c, mute) for c in reversed(x.children))
    end()
    return out


def number(seed: Node) -> list[Node]:
    nodes = preorder(seed)
    for i, node in enumerate(nodes):
        node.mark = i
    return nodes


@dataclass
class Wrapper:
    """What a host's pages have in common: the numbered seed, the texts of its template nodes, and the article's slot."""

    seed: Node
    template: dict[int, str]
    slot: int | None


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of one page, by its host's wrapper if there is one."""
    if not page:
        return ""
    tree = parse(page)
    if wrapper:
        match(wrapper.seed, tree)
    roots = roots_of(tree, wrapper.slot if wrapper else None)
    kept = [b for x in roots for b in blocks(x, wrapper.template)] if wrapper and wrapper.template else []
    return "\n".join(kept or [b for x in roots for b in blocks(x, {})])


def varying(tree: Node, texts: list[str]) -> Iterator[tuple[int, int]]:
    """(seed's node, letters) of the blocks of an aligned page that read otherwise than the seed's: those of unmatched blocks count for the matched node around them.

    Blocks of links alone, and elements whose role is none of an article's, do not count.
    """
    stack = [(tree, 0)]
    while stack:
        x, around = stack.pop()
        if x.tag in DROPPED or x.attributes and is_boilerplate(x, False):
            continue
        around = x.mark if x.mark >= 0 else around
        if (x.tag in BLOCKS or x.tag == "#root") and any(c.strip() if isinstance(c, str) else c.tag not in BLOCKS and c.tag != "a" for c in x.children):
            text = own_text(x)
            if text and (x.mark < 0 or text != texts[x.mark]):
                yield around, len(text)
        stack.extend((c, around) for c in x.nodes)


def host_of(url: Column) -> Column:
    """Host of an absolute address, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


class _Seeds:
    """Numbered trees of recent seeds with their nodes' texts, by text."""

    def __init__(self, most: int = 64):
        self.most, self.held = most, {}

    def __call__(self, seed: str) -> tuple[Node, list[Node], list[str]]:
        if seed not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            nodes = number(tree := parse(seed))
            self.held[seed] = (tree, nodes, [own_text(x) for x in nodes])
        return self.held[seed]


def induce(rows: DataFrame, least_pages: int, share: float) -> DataFrame:
    """(host, seed, pages, template, mass) of each host: its seed page, the numbers of the seed's constant nodes, and the varying text of each of its nodes."""
    # A seed with a closed document, of middling size, is aligned best; ties go to the smaller id.
    # Of seeds in one class the choice does not matter: constant nodes are constant in any.
    order = F.struct((~F.col("html").endswith("</html>")).alias("open"), (F.length("html") > 65_536).alias("long"), "page_id", "html")
    # Copies of a page count once: (host, digest of the page) are grouped, and each of n copies weighs 1/n.
    usable = rows.where("host is not null and length(html) > 0").withColumn("digest", F.xxhash64("html"))
    distinct = materialise(usable.groupBy("host", "digest").agg(F.count("*").alias("copies")), "pages")
    sizes = distinct.groupBy("host").agg(F.count("*").alias("pages"), F.sum("copies").alias("rows")).where(F.col("pages") >= least_pages)
    seeds = materialise(usable.groupBy("host").agg(F.min(order).alias("s")).join(sizes, "host").select("host", F.col("s.html").alias("seed"), "pages", "rows"), "seeds")
    copied = distinct.where("copies > 1").select("host", F.col("digest").alias("copied"), "copies")
    copied = maybe_broadcast(copied.withColumnRenamed("host", "copied_of"), F.octet_length("copied_of") + 32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Seeds()
        for b in slices(batches, "html"):
            equal: dict[tuple[str, int], float] = {}
            mass: dict[tuple[str, int], float] = {}
            for host, page, seed, copies in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                tree, _, texts = known(seed)
                page_tree = parse(page)
                match(tree, page_tree)
                for node in preorder(page_tree):
                    if node.mark >= 0 and texts[node.mark] and own_text(node) == texts[node.mark]:
                        equal[host, node.mark] = equal.get((host, node.mark), 0.0) + 1 / copies
                for mark, letters in varying(page_tree, texts):
                    mass[host, mark] = mass.get((host, mark), 0.0) + letters / copies
            keys = list(equal.keys() | mass.keys())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([d.get(k, 0.0) for k in keys], pa.float64()) for d in (equal, mass))], ["host", "node", "equal", "mass"])

    pages = left_join_counted(usable, seeds, "host", "rows", F.octet_length("seed") + 72).where("seed is not null")
    pages = pages.join(copied, (F.col("host") == F.col("copied_of")) & (F.col("digest") == F.col("copied")), "left")
    counted = pages.select("host", "html", "seed", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(count, "host string, node int, equal double, mass double").groupBy("host", "node").agg(F.round(F.sum("equal")).alias("equal"), F.round(F.sum("mass")).alias("mass"))
    constant = (F.col("equal") >= least_pages) & (F.col("equal") >= share * F.col("pages"))
    # Lists of the nodes of one page: bounded by the seed.
    found = counted.join(seeds.select("host", "pages"), "host").groupBy("host").agg(F.sort_array(F.collect_list(F.when(constant, F.col("node")))).alias("template"), F.sort_array(F.collect_list(F.when(F.col("mass") > 0, F.struct("node", "mass")))).alias("mass"))
    return seeds.join(found, "host").select("host", "seed", "rows", "template", "mass")


def main_text(pages: DataFrame, least_pages: int = 5, share: float = 0.8, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, from its whole html."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    wrappers = materialise(induce(rows, least_pages, share), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wrapped = _Seeds(), {}
        for b in slices(batches, "html"):
            texts = []
            for host, page, seed, template, mass in zip(*(b.column(i).to_pylist() for i in (2, 3, 4, 5, 6)), strict=True):
                if seed and host not in wrapped:
                    if len(wrapped) >= known.most:
                        wrapped.clear()
                    tree, nodes, own = known(seed)
                    wrapped[host] = Wrapper(tree, {i: own[i] for i in template}, slot_of(nodes, {m["node"]: m["mass"] for m in mass}))
                texts.append(extract(page, wrapped[host] if seed else None))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = left_join_counted(rows, wrappers, "host", "rows", F.octet_length("seed") + 4 * F.size("template") + 16 * F.size("mass") + 72)
    out = joined.select("page_id", "url", "host", "html", "seed", "template", "mass").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("bigint").alias("n_chars"))
