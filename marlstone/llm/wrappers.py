"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host.

A page is a well-nested stream of tags and texts. Neighbouring runs of equal labels fold into repeated
groups. Then streams of one host are aligned two at a time: what both have is merged, what only one
has becomes an optional group, and texts that differ become slots. The result, the host's wrapper,
has one node for each place of the template, with how many pages have it and how much slot text and
link text it holds. It gives the rule for the host: the place that holds the slot text, the places
that a name calls furniture but the slot text says are none, those that hold little but links, and the
texts that nearly all pages with that place have in common. Each page is then read once more, under
its host's rule. Names of classes and ids are a prior only: an element that the wrapper shows to hold
the host's text stays, whatever it is called.

All pages of a host are aligned. Each task aligns its own pages first, so a host with a third of all
pages sends one wrapper a task, and those meet in two steps (host and salt, then host), one at a time.
Depth and width of a page are not bounded: no walk depends on the interpreter's recursion limit, and
sibling lists are aligned by bit vectors.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Different pages that must agree before a common text counts as part of the template.
TEMPLATE_PAGES = 3
#: Share of the pages with the host's place by which a text must lead over other texts to be template.
TEMPLATE_LEAD = 0.8
#: A place that names call furniture stays if it holds so many times the slot text of all other places.
OUTVOTED = 4
#: Outside paragraphs, a block of at least so many links that are this share of its text holds links only.
LINKS, LINK_SHARE = 3, 0.85
#: Bits that one alignment of sibling lists may hold; longer ones are halved first.
ALIGN_BITS = 1 << 28
#: Wrappers a task holds before it sends them on, and rules that may be broadcast.
TASK_HOSTS, BROADCAST_RULES = 2000, 20_000

# Fixed values of HTML: elements without content, elements whose content is no markup, blocks, and
# which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg annotation annotation-xml iframe object select canvas title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body html caption dd dt li legend optgroup option summary tbody td tfoot th thead tr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table select article section div main body".split())
# Fixed values of page furniture: elements, and words of class and id attributes.
FURNITURE = frozenset("head nav header footer aside form menu dialog button fieldset label".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus feedback footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager paywall popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)

#: Words that make a name like "entry-header" that of a part of the text; and what even the slot text can't make text.
CONTENT_NAMES = frozenset("article content entry main page post story title".split())
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Names that say little of a paragraph or heading inside the text: what it holds decides.
DOUBTFUL = frozenset("notice notices related feedback header banner banners".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong span code".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/a-zA-Z][^>]*(?:>|\Z)|([^<]+|<)", re.S)
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")

sys.setrecursionlimit(max(sys.getrecursionlimit(), 2_000_000))  # folding and merging follow a page's depth; frames of Python code live on the heap


# --- pages ------------------------------------------------------------------------------------


class Node:
    """An element: tag, label (tag with up to four of its class and id words), children (nodes and strings).

    ``furniture`` is 2 if the tag says so, 1 if only a name does, else 0.
    """

    __slots__ = ("furniture", "kids", "label", "tag")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        self.tag, self.kids = tag, []
        self.label = ".".join((tag, *names)) if names else tag
        self.furniture = _furniture(tag, names)


def _telling(name: str) -> bool:
    """Whether a class or id word names furniture; "entry-header" and the like are part of the text."""
    words = _SPLIT.split(name)
    found = [w for w in words if w in FURNITURE_NAMES]
    return bool(found) and not (all(w in ("header", "masthead") for w in found) and any(w in CONTENT_NAMES for w in words))


def _furniture(tag: str, names: tuple[str, ...]) -> int:
    if tag in FURNITURE:
        return 2
    for name in names:
        if _telling(name):
            return 1
    return 0


_KNOWN: dict[str, int] = {}


def _kind(label: str) -> int:
    """``furniture`` of a label."""
    if label not in _KNOWN:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        tag, *names = label.split(".")
        _KNOWN[label] = _furniture(tag, tuple(names))
    return _KNOWN[label]


def _kept(names: set[str]) -> tuple[str, ...]:
    """Four names for the label, those of furniture first, numbers in them alike: a label is furniture if any of the names is."""
    names = {_DIGITS.sub("0", n).replace(".", "-") for n in names}
    first = sorted(names, key=lambda n: (not _telling(n), n))[:4] if len(names) > 4 else names
    return tuple(sorted(first))


def parse(html: str) -> Node:
    """The tree of a page, read leniently: unknown ends are skipped, missing ones implied.

    Elements whose content is no markup are left out. One that is never closed loses only its start
    tag, but for scripts and styles, which run to the end as in browsers; one that ends in "/>" is empty.
    """
    root = Node("")
    stack, opened, missing = [root], Counter(), set()
    at, scan, size = 0, _TOKEN.match, len(html)
    while at < size:
        m = scan(html, at)
        if m is None:
            break
        at = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            kids = stack[-1].kids
            if kids and isinstance(kids[-1], str):
                kids[-1] += text
            else:
                kids.append(text)
            continue
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        for x in stack[k:]:
                            opened[x.tag] -= 1
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPES and tag not in SCOPES and tag != "html":
                        break
            continue
        empty = m[3].endswith("/")
        if tag in RAW:
            if not empty and tag not in missing:
                end = _END[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    break
                else:
                    missing.add(tag)
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].kids.append(Node(tag))
            continue
        ends = ENDS.get(tag)
        closes_p = tag in ENDS_P and opened["p"] > 0
        if closes_p or ends and any(opened[x] > 0 for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                open_ = stack[k].tag
                if open_ == "p" and closes_p or ends and open_ in ends:
                    for x in stack[k:]:
                        opened[x.tag] -= 1
                    del stack[k:]
                    if tag not in ("tr", "tbody"):
                        break
                elif open_ in SCOPES:
                    break
        names = ()
        if m[3]:
            names = _kept({w for g in _NAMES.findall(m[3]) for x in g for w in x.lower().split()})
        node = Node(tag, names)
        stack[-1].kids.append(node)
        if not empty or tag in ("p", "div", "article", "a", "b", "span"):
            stack.append(node)
            opened[tag] += 1
    return root


def clean(text: str) -> str:
    return " ".join(unescape(text).split())


def step(at: int, label: str) -> int:
    """The number of a place: that of its parent's place and its own label."""
    return xxhash.xxh64_intdigest(label, at) >> 1


# --- wrappers ---------------------------------------------------------------------------------
# A wrapper node is [label, repeated, optional, pages, for texts [hash, lead], slot characters, link
# characters, children]. Texts have the label "#", groups "(...)". The lead is a majority count: a
# text on n pages more than all others at its place leads by n at least; a lead of all pages is no slot.


def wrapper_of(html: str) -> list:
    """The wrapper of one page; its root keeps a hash of the page's text outside furniture."""
    root = parse(html)
    found = fold(root)
    found[4] = [crc32(_plain(root).encode())] if found[7] else []
    found[3] = 1 if found[7] else 0  # empty pages don't count
    return found


def _plain(root: Node) -> str:
    """The page's text outside furniture."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.furniture or x is root:
            todo.extend(reversed(x.kids))
    return "\n".join(out)


def fold(node: Node, linked: bool = False) -> list:
    """A page's tree as wrapper nodes, children before their parents."""
    top: list = []
    todo: list[tuple] = [(node, linked, top, None)]
    while todo:
        x, in_link, siblings, kids = todo.pop()
        if isinstance(x, str):
            if text := clean(x):
                siblings.append(["#", False, False, 1, [crc32(text.encode()), 1], len(text), len(text) if in_link else 0, []])
        elif kids is not None:
            siblings.append([x.label, False, False, 1, None, 0, 0, _repeats(kids)])
        elif x.tag != "br":
            kids = []
            todo.append((x, in_link, siblings, kids))
            inside = in_link or x.tag == "a"
            todo.extend((k, inside, kids, None) for k in reversed(x.kids))
    return top[0]


def _same(out: list, width: int) -> bool:
    """Whether the last ``width`` nodes have the labels of those before them."""
    for k in range(1, width + 1):
        if out[-k][0] != out[-k - width][0]:
            return False
    return True


def _repeats(kids: list) -> list:
    """Neighbouring equal runs of one to three nodes as repeated nodes or groups."""
    for width in (1, 2, 3):
        out: list = []
        for x in kids:
            out.append(x)
            while len(out) >= 2 * width and _same(out, width) and not (width == 1 and out[-1][0] == "#"):
                tail = out[-width:]
                del out[-width:]
                for k in range(width):
                    merged = merge(out[k - width], tail[k], pages=False)
                    merged[1] = True
                    out[k - width] = merged
                break
        kids = out
    return kids


def merge(a: list, b: list, pages: bool = True) -> list:
    """The wrapper of all that ``a`` and ``b`` stand for; both have the same label."""
    if a[0] == "#":
        (x, m), (y, n) = a[4], b[4]
        common = [x, m + n if pages else max(m, n)] if x == y else [x if (m, x) > (n, y) else y, abs(m - n)] if pages else [x, 0]
    else:  # of a root the smallest hashes of its pages, enough of them to know that so many pages differ
        common = sorted({*a[4], *b[4]})[:TEMPLATE_PAGES] if a[4] is not None else None
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3] if pages else max(a[3], b[3]), common, a[5] + b[5], a[6] + b[6], _align(a[7], b[7], pages)]


def _lcs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence: bit vectors over b, a row for each element of a.

    Lists whose rows would hold more than ``ALIGN_BITS`` are halved where a longest one passes
    (Hirschberg), so memory is bounded and the result exact.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if n > 1 and n * m > ALIGN_BITS:
        half = n // 2
        first, last = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(m + 1), key=lambda j: first[j] + last[j])
        return _lcs(a[:half], b[:cut]) + [(half + i, cut + j) for i, j in _lcs(a[half:], b[cut:])]
    rows, out = list(_rows(a, b)), []
    i, j = n, m
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a: a number whose zero bits mark where the length of the common subsequence grows along b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    whole = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & whole
        yield row


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of a with each prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out = [0]
    for c in reversed(f"{row:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (c == "0"))
    return out


def _align(a: list, b: list, pages: bool) -> list:
    """Children in order: those matched merge, the others become optional."""
    n, m = len(a), len(b)
    head = 0
    while head < n and head < m and a[head][0] == b[head][0]:
        head += 1
    out = [merge(a[k], b[k], pages) for k in range(head)]
    if head == n == m:
        return out
    tail = 0
    while tail < n - head and tail < m - head and a[n - 1 - tail][0] == b[m - 1 - tail][0]:
        tail += 1
    number: dict[str, int] = {}
    left, right = ([number.setdefault(x[0], len(number)) for x in y] for y in (a[head : n - tail], b[head : m - tail]))
    i = j = head
    for p, q in [*_lcs(left, right), (n - tail - head, m - tail - head)]:
        out += [_optional(x) for x in a[i : head + p]] + [_optional(x) for x in b[j : head + q]]
        i, j = head + p + 1, head + q + 1
        if head + p < n - tail:
            out.append(merge(a[head + p], b[head + q], pages))
    out += [merge(a[n - k], b[m - k], pages) for k in range(tail, 0, -1)]
    return _repeats(out)


def _optional(x: list) -> list:
    return [x[0], x[1], True, *x[3:]]


def packed(w: list) -> str:
    """A wrapper as text: its nodes one after another, each with the number of its children."""
    out, todo = [], [w]
    while todo:
        x = todo.pop()
        out.append([x[0], int(x[1]), int(x[2]), x[3], x[4], x[5], x[6], len(x[7])])
        todo.extend(reversed(x[7]))
    return json.dumps(out, separators=(",", ":"))


def unpacked(text: str) -> list:
    root: list = []
    open_: list[list] = [[root, 1]]
    for label, repeated, optional, pages, own, slot, link, kids in json.loads(text):
        node = [label, bool(repeated), bool(optional), pages, own, slot, link, []]
        open_[-1][0].append(node)
        open_[-1][1] -= 1
        open_.append([node[7], kids])
        while open_ and not open_[-1][1]:
            open_.pop()
    return root[0]


def expression(w: list) -> str:
    """The wrapper as a readable expression: #text slots, fixed texts, + and ? on groups."""
    marks = ("+" if w[1] else "") + ("?" if w[2] else "")
    if w[0] == "#":
        return ("#fixed" if w[4][1] == w[3] else "#text") + marks
    inner = " ".join([expression(x) for x in w[7]])
    return f"<{w[0]}>{inner}</>" + marks if not marks else f"(<{w[0]}>{inner}</>){marks}"


class Places:
    """The wrapper's elements in page order, each with its place, parent, and sums over all below it."""

    def __init__(self, w: list):
        self.node, self.place, self.parent = [w], [0], [-1]
        todo = [(x, 0) for x in reversed(w[7])]
        while todo:
            x, up = todo.pop()
            if x[0] == "#":
                continue
            k = len(self.node)
            self.node.append(x)
            self.place.append(step(self.place[up], x[0]))
            self.parent.append(up)
            todo.extend((y, k) for y in reversed(x[7]))
        self.kinds = [0] + [_kind(x[0]) for x in self.node[1:]]
        n = len(self.node)
        self.links = [0] * n  # links, and characters inside and outside of links, furniture by tag left out
        self.linked, self.own = [0] * n, [0] * n
        for k in range(n - 1, -1, -1):
            x = self.node[k]
            for y in x[7]:
                if y[0] == "#":
                    self.linked[k] += y[6]
                    self.own[k] += y[5] - y[6]
            up = self.parent[k]
            if up >= 0 and self.kinds[k] < 2:
                self.links[up] += (self.links[k] + x[3] * (x[0].split(".")[0] == "a")) * (LINKS if x[1] else 1)  # repeated: some at least
                self.linked[up] += self.linked[k]
                self.own[up] += self.own[k]

    def content(self, gone: list[bool]) -> list[int]:
        """Slot characters below each element that lie in no place that is gone."""
        n = len(self.node)
        out = [sum([y[5] - y[6] for y in x[7] if y[0] == "#"]) for x in self.node]
        for k in range(n - 1, 0, -1):
            if gone[k]:
                out[k] = 0
            out[self.parent[k]] += out[k]
        return out


def _doubtful(label: str) -> bool:
    """Whether the names that call an element furniture may be about its subject: "notice" of a paragraph, "health-related" of anything."""
    tag, *names = label.split(".")
    for words in (_SPLIT.split(name) for name in names if _telling(name)):
        found = [w for w in words if w in FURNITURE_NAMES]
        adjective = found == ["related"] and words[-1] == "related" and len(words) > 1 and words[-2] not in CONTENT_NAMES
        if not adjective and not (tag in PARAGRAPHS and DOUBTFUL.issuperset(found)):
            return False
    return True


def _stays(p: Places) -> list[bool]:
    """Elements that names or tags call furniture, but not where they stand.

    In the text: those of doubtful names unless most of their text is links. In a main element: a header
    with a heading of its page's own. Texts that all pages have there still go as template.
    """
    n = len(p.node)
    main, article, text, stays = [False] * n, [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        x, up = p.node[k], p.parent[k]
        tag, *names = x[0].split(".")
        main[k], article[k] = main[up] or tag == "main", article[up] or tag == "article"
        text[k] = text[up] or main[k] or article[k] or not p.kinds[k] and any([w in CONTENT_NAMES for name in names for w in _SPLIT.split(name)])
        if p.kinds[k] == 1:
            stays[k] = text[up] and p.own[k] > p.linked[k] and _doubtful(x[0])
        elif tag == "header" and main[up] and not article[up]:
            todo, heading = list(x[7]), False
            while todo and not heading:
                y = todo.pop()
                if y[0] == "#" or _kind(y[0]) == 2:
                    continue
                if y[0].split(".")[0] in ("h1", "h2"):
                    heading = _of_page(y)
                else:
                    todo.extend(y[7])
            stays[k] = heading
    return stays


def _of_page(x: list) -> bool:
    """Whether some text below differs from page to page, or too few pages have it to tell."""
    todo = [x]
    while todo:
        y = todo.pop()
        if y[0] == "#" and y[4][1] < max(TEMPLATE_PAGES, TEMPLATE_LEAD * y[3]):
            return True
        todo.extend(y[7])
    return False


def _votes(p: Places) -> list[bool]:
    """Which elements are furniture: by tag, by name unless outvoted by slot text or by where they stand, or as lists of links."""
    n = len(p.node)
    stays = _stays(p)
    gone = [x > 0 and not y for x, y in zip(p.kinds, stays, strict=True)]
    rest = p.content(gone)[0]
    for k in range(1, n):  # parents first: an element that stays lets those inside it be judged against it
        if p.kinds[k] == 1 and gone[k]:
            tag, *names = p.node[k][0].split(".")
            if tag not in ("html", "body", "main", "article") and any([w in READERS for name in names for w in _SPLIT.split(name)]):
                continue
            if p.own[k] >= OUTVOTED * max(1, rest):
                gone[k] = False  # what names inside it call furniture still is, unless it holds nearly all in turn
                rest = p.content(gone)[0]
    total = rest
    for k in range(1, n):
        x, tag = p.node[k], p.node[k][0].split(".")[0]
        if not gone[k] and tag in ("div", "ul", "ol", "section", "table", "center") and p.links[k] >= LINKS * x[3] and p.linked[k] >= LINK_SHARE * (p.linked[k] + p.own[k]) and 2 * p.own[k] < total:
            up = p.parent[k]
            while up > 0 and p.node[up][0].split(".")[0] not in ("article", "p"):
                up = p.parent[up]
            gone[k] = up <= 0  # a list of links inside an article is part of it
    return gone


def rule(w: list) -> dict:
    """The host's rule, places as numbers: ``main`` holds the text, ``kept`` and ``gone`` overrule names,
    ``fixed`` maps a place to the hash of a text that nearly all pages with it have.

    Short of an article or main element, the main place is only narrowed while all that lies beside
    it outside furniture is template.
    """
    p = Places(w)
    gone = _votes(p)
    content = p.content(gone)
    kids: list[list[int]] = [[] for _ in p.node]
    for k in range(1, len(p.node)):
        kids[p.parent[k]].append(k)
    steps, at, total = [], 0, content[0]
    while total > 0:
        kid = max(kids[at], key=lambda k: content[k], default=-1)
        tag = p.node[kid][0].split(".")[0] if kid >= 0 else ""
        if kid < 0 or content[kid] < 0.8 * total or content[kid] and tag not in ("article", "main") and (tag in ("p", "li", "ul", "ol", "table", "blockquote", "pre") or tag not in BLOCKS):
            break
        steps.append((at, kid))
        at = kid
        if tag in ("article", "main"):
            break
    # pages of other kinds don't count, unless the place is that of a few long pages
    pages = p.node[at][3] if 2 * p.node[at][3] >= w[3] else w[3]
    differ = len(w[4] or ()) >= TEMPLATE_PAGES  # else copies of a page would make its own text template
    fixed: dict[str, int] = {}
    template, out, slots = set(), [False] * len(p.node), 0
    for k, x in enumerate(p.node):
        out[k] = gone[k] or k > 0 and out[p.parent[k]]
        if out[k]:
            continue
        for y in x[7]:
            if y[0] == "#":
                text, lead = y[4]
                if differ and lead >= max(TEMPLATE_PAGES, TEMPLATE_LEAD * pages):
                    fixed[str(p.place[k])] = text
                    template.add(id(y))
                if lead < y[3]:
                    slots += y[5]
    if not slots:
        fixed, template = {}, set()
    holds = [any([y[0] == "#" and y[5] > 0 and id(y) not in template for y in x[7]]) for x in p.node]
    for k in range(len(p.node) - 1, 0, -1):
        holds[k] = holds[k] and not gone[k]
        holds[p.parent[k]] |= holds[k]
    if not (steps and p.node[at][0].split(".")[0] in ("article", "main")):
        for m, (up, kid) in enumerate(steps):
            own = any([y[0] == "#" and y[5] > 0 and id(y) not in template for y in p.node[up][7]])
            if own or any([holds[k] for k in kids[up] if k != kid]):
                steps = steps[:m]
                break
    return {
        "main": str(p.place[steps[-1][1]]) if steps else None, "fixed": fixed,
        "kept": [str(p.place[k]) for k in range(1, len(p.node)) if p.kinds[k] and not gone[k]],
        "gone": [str(p.place[k]) for k in range(1, len(p.node)) if not p.kinds[k] and gone[k]],
    }


_NO_RULE = {"main": None, "fixed": {}, "kept": [], "gone": []}


class _Rule:
    """A rule with its places as numbers."""

    def __init__(self, found: dict):
        self.main = int(found["main"]) if found["main"] else None
        self.fixed = {int(k): v for k, v in found["fixed"].items()}
        self.kept, self.gone = set(map(int, found["kept"])), set(map(int, found["gone"]))

    def furniture(self, x: Node, at: int) -> bool:
        return x.furniture > 0 and at not in self.kept or at in self.gone


def extract(html: str, found: dict | _Rule | None) -> str:
    """Blocks of the main text in page order, joined by empty lines."""
    root = parse(html)
    own = found if isinstance(found, _Rule) else _Rule(found or _NO_RULE)

    def find(hit) -> list[tuple[Node, int, bool]]:
        out, todo = [], [(root, 0, False)]
        while todo:
            node, at, article = todo.pop()
            if node is not root and hit(node, at):
                out.append((node, at, article or node.tag == "article"))
                continue
            for x in reversed(node.kids):
                if not isinstance(x, str):
                    here = step(at, x.label)
                    if not own.furniture(x, here):
                        todo.append((x, here, article or node.tag == "article"))
        return out

    roots = find(lambda x, at: at == own.main) if own.main is not None else []
    roots = roots or find(lambda x, at: x.tag in ("article", "main")) or [(root, 0, False)]
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if text := clean("".join(run)):
                out.append(text)
            run.clear()

    for top in roots:
        todo: list[tuple] = [top]
        while todo:
            x, at, article = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                if not (own.fixed and own.fixed.get(at) == crc32(clean(x).encode())):
                    run.append(x)
            else:
                inside = article or x.tag == "article"
                for y in reversed(x.kids):
                    if isinstance(y, str):
                        todo.append((y, at, inside))
                    elif y.tag == "br":
                        todo.append((" ", -1, inside))
                    else:
                        here = step(at, y.label)
                        if not own.furniture(y, here) or y.tag == "header" and inside:
                            block = y.tag in BLOCKS
                            if block:
                                todo.append((None, 0, False))
                            todo.append((y, here, inside))
                            if block:
                                todo.append((None, 0, False))
        end()
    return "\n\n".join(out)


# --- Spark ------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, wrapper`` (as text) from all pages of each host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(map(packed, held.values())), pa.string())], names=["host", "wrapper"])
        for batch in batches:
            for host, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = wrapper_of(x.as_py() or "")
                held[host] = merge(held[host], w) if host in held else w
                if len(held) >= TASK_HOSTS:
                    yield out()
                    held = {}
        if held:
            yield out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: one wrapper of the host in hand, one that comes."""
        last, w = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]], pa.string()), pa.array([packed(w)], pa.string())], names=["host", "wrapper"])
        for batch in batches:
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True), batch.column(1), strict=True):
                found = unpacked(text.as_py())
                if key == last:
                    w = merge(w, found)
                else:
                    if last is not None:
                        yield one()
                    last, w = key, found
        if last is not None:
            yield one()

    schema = "host string, wrapper string"
    mark = F.xxhash64("wrapper")
    first = pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(partial, schema)
    salted = first.withColumn("salt", F.pmod(mark, F.lit(64))).repartition("host", "salt").sortWithinPartitions("host", "salt", mark).mapInArrow(join, schema)
    return salted.withColumn("salt", F.lit(0).cast("long")).repartition("host").sortWithinPartitions("host", mark).mapInArrow(join, schema)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    Null or empty html gives an empty text. Pages without a host (null or odd url) share one wrapper.
    Character references are decoded and white space inside a block becomes one space. Texts that
    fewer than ``TEMPLATE_PAGES`` pages agree on are never taken for template. Pages of any length,
    depth and width are read whole. Repeated rows count as pages; other columns are dropped, whatever
    their names; an empty table gives an empty result.
    """

    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(rule(unpacked(x.as_py()))) for x in batch.column(1)], pa.string())], names=["_host", "_rule"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Rule] = {}
        for batch in batches:
            texts = []
            for x, r in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if r and r not in known:
                    if len(known) > TASK_HOSTS:
                        known.clear()
                    known[r] = _Rule(json.loads(r))
                texts.append(extract(x.as_py() or "", known.get(r)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[page_id, url, "text", "n_chars"])

    found = written(infer(pages, url, html).mapInArrow(rules, "_host string, _rule string"), "rules")
    rows = pages.select(F.col(page_id), F.col(url), F.col(html), host_of(F.col(url)).alias("_host"))
    joined = rows.join(small(found, BROADCAST_RULES), "_host", "left").select(page_id, url, html, "_rule")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"`{page_id}` {kinds[page_id]}, `{url}` {kinds[url]}, text string, n_chars long")
