"""HTML extraction: wrapper induction.

Of every host up to SAMPLE pages (the first by a hash in each of as many buckets, whatever the host's size) are parsed, and their DOM
trees, of any size and depth, are aligned by simple tree matching with the page that matches the others best. Aligned nodes of equal text on
two thirds of the pages (VOTES at least) are template; what varies is a slot. The wrapper is the path of the
container, the deepest block that occurs once a page and holds SHARE of the varying text, and the template inside it. Every page is read
with its host's wrapper: the text of the container's slots. A page without one (a lone page, no host, another
layout) is read whole, or its marked-up article.

Tags, roles and classes are evidence only. Elements that look like menus, headers, footers, sidebars, notices, adverts, forms or
comments go first, since two pages of a host may show different adverts, which no alignment can tell from an article; but none
goes that holds all marked-up articles or, without any, most of the page's text. <article> and <main> weigh more as containers (MARKED).
Pages with copies of one marked-up article, or of one page, count as one vote, so that these are no template.

Defined cases: null html is empty and has an empty text; unclosed and misnested elements are closed as browsers
do for paragraphs, lists and tables; `<br>` is white space; a tag that never ends hides what follows it; pages of null or host-less URLs have no
wrapper; repeated rows each get their row; an empty table gives an empty result. Parsing is linear in the page.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, bounded_batches, row_salt, shielded, sized, stored, table

#: Pages of a host that are aligned; parts of the varying text that a container holds, any and a marked one; pages that make a node template.
SAMPLE, SHARE, MARKED, VOTES = 8, 0.75, 0.3, 3
#: Bytes of all wrappers that may be broadcast.
WRAPPER_BYTES = 32 << 20

# possessive throughout: nothing is read twice
_INSIDE = re.compile(r"""([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_PLAIN = re.compile(r"([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
STOPS = (BLOCK - {"p"}) | {"button", "object"}
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "tbody", "thead"), ("table",)), "option": (("option",), ("select",))}
GONE_TAGS = frozenset("head button select input label object embed canvas audio video map svg template menu".split()) | RAW
LIKELY_TAGS = frozenset("nav header footer aside form dialog".split())
LIKELY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
GONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations skip toolbar captcha".split()
)
#: What a name of GONE_WORDS may hold besides: boxes, places and numbers, but no word of its own.
BOX_WORDS = frozenset("area aside banner bar block box btn button buttons col column container form group holder icons inner item items left link links list outer panel primary right secondary section slot space title top unit wrap wrapper bottom".split())
GONE_NAMES = frozenset("header site-header page-header banner top-bar topbar alert".split())
#: Blocks that are parts of a text and never its container.
PARTS = frozenset("p li dd dt td th tr h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption summary option legend address".split())


def gone_name(name: str) -> bool:
    """Whether a class or id as a whole names boilerplate: not has-sidebar, nav-open or related-work."""
    parts = [x for x in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])", name) if x and not x.isdigit()]
    return name in GONE_NAMES or (not GONE_WORDS.isdisjoint(parts) and all(x in GONE_WORDS or x in BOX_WORDS for x in parts))


@functools.lru_cache(1 << 14)
def _kind(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """Of a start tag: its kind (tag, classes and id with digits made one), whether it goes, likely goes, and is a marked article."""
    a: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        a.setdefault(k.lower(), html.unescape(v.strip("\"'")))
    classes, name, role = a.get("class", "").lower().split(), a.get("id", "").lower(), a.get("role", "").lower()
    kind = re.sub("[0-9]+", "0", f"{tag}.{'.'.join(sorted(classes))}#{name}")
    marked = tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", "")
    named = tag in BLOCK and tag not in ("html", "body") and not marked and any(map(gone_name, [*classes, *name.split()]))
    return kind, tag in GONE_TAGS, tag in LIKELY_TAGS or role in LIKELY_ROLES or hidden or named, marked


class Node:
    __slots__ = ("tag", "sig", "gone", "likely", "marked", "kids")

    def __init__(self, tag: str, attrs: str) -> None:
        self.tag, self.kids = tag, []
        kind = _kind if len(attrs) < 256 else _kind.__wrapped__  # long ones are not kept in memory
        self.sig, self.gone, self.likely, self.marked = kind(tag, attrs if _TELLING.search(attrs) else "")

    def own(self) -> str:
        return " ".join("".join(k for k in self.kids if isinstance(k, str)).split())


class _Open:
    """The open elements; where each tag stands among them, so that no search walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.stops = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in STOPS:
            self.stops.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag in STOPS:
                self.stops.pop()

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else 0

    def close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        k = max(map(self.last, tags))
        if k and k > max(map(self.last, scope)):
            self.cut(k)


def parse(page: str) -> Node:
    root = Node("#root", "")
    open_, end, shut = _Open(root), len(page), page.rfind(">")
    at = 0
    while at < end:
        lt = page.find("<", at)
        mark = page[lt + 1 : lt + 2] if lt >= 0 else ""
        while lt >= 0 and not (mark in ("!", "?", "/") or (mark.isascii() and mark.isalpha())):
            lt = page.find("<", lt + 1)
            mark = page[lt + 1 : lt + 2] if lt >= 0 else ""
        if lt != at:
            open_.stack[-1].kids.append(html.unescape(page[at : lt if lt >= 0 else end]))
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith("<![CDATA[", lt):
            stop = page.find("]]>", lt + 9)
            open_.stack[-1].kids.append(page[lt + 9 : stop if stop >= 0 else end])
            at = stop + 3 if stop >= 0 else end
            continue
        if lt > shut:
            break
        ends = mark == "/"
        m = (_INSIDE.match(page, lt + 1 + ends) or _PLAIN.match(page, lt + 1 + ends)) if mark not in ("!", "?") else None
        if m is None:  # a declaration, or an end tag without a name
            at = page.find(">", lt) + 1
            continue
        at, tag, text = m.end(), m[1].lower(), m[2]
        if ends:
            k = open_.last(tag)
            if k and ((tag in BLOCK and tag != "p") or k > open_.stops[-1]):
                open_.cut(k)
            continue
        if tag in RAW:
            stop = _end_of(tag).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSES:
            for _ in range(3):
                open_.close(*CLOSES[tag])
        if tag in ENDS_P and open_.last("p") > open_.stops[-1]:
            open_.cut(open_.last("p"))
        node = Node(tag, text.strip())
        open_.stack[-1].kids.append(node)
        if tag not in VOID and not (tag == "svg" and text.endswith("/")):
            open_.push(node)
    return root


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def shrunk(root: Node) -> Node:
    """Takes out what is gone, and what likely is, unless it holds all marked nodes or, without any, most of the text."""
    order, todo = [], [(root, -1, False)]
    while todo:
        x, up, inside = todo.pop()
        x.kids = [k for k in x.kids if isinstance(k, str) or not k.gone]
        if inside and x.tag == "header":  # of the article, not of the site
            x.likely = False
        todo += [(k, len(order), inside or x.marked) for k in x.kids if isinstance(k, Node)]
        order.append((x, up))
    if any(x.likely for x, _ in order):
        # marked nodes inside what likely goes (a comment as <article>) do not count, unless there are no others
        lost = [False] * len(order)
        for k, (x, up) in enumerate(order):
            lost[k] = x.likely or (up >= 0 and lost[up])
        free = any(x.marked and not lost[k] for k, (x, _) in enumerate(order))
        marks = [int(x.marked and not (free and lost[k])) for k, (x, _) in enumerate(order)]
        texts = [len(x.own()) for x, _ in order]
        for k in range(len(order) - 1, 0, -1):
            marks[order[k][1]] += marks[k]
            texts[order[k][1]] += texts[k]
        for k, (x, _) in enumerate(order):
            x.gone = x.likely and not (0 < marks[0] == marks[k] or (not marks[0] and 2 * texts[k] > texts[0]))
        for x, _ in order:
            x.kids = [k for k in x.kids if isinstance(k, str) or not k.gone]
    return root


def _down(path: str, node: Node) -> str:
    """The path of a child, as a digest: paths stay short however deep a page nests."""
    return xxhash.xxh64_hexdigest(f"{path}/{node.sig}".encode("utf-8", "surrogatepass"))


def _digest(path: str, text: str) -> str:
    return xxhash.xxh64_hexdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


class Tree:
    """A page's nodes, parents first, as lists: kind, place of the parent, children, path, digest of the own text ("" without one) and its length."""

    def __init__(self, root: Node) -> None:
        self.sig, self.up, self.kids, self.path, self.text, self.size, self.tag, self.marked = [], [], [], [], [], [], [], []
        todo = [(root, "", -1, False)]
        while todo:
            x, path, up, link = todo.pop()
            k, own, link = len(self.sig), x.own(), link or x.tag == "a"
            for column, v in ((self.sig, x.sig), (self.up, up), (self.kids, []), (self.path, path), (self.text, _digest(path, own) if own else ""), (self.size, 0 if link else len(own)), (self.tag, x.tag), (self.marked, x.marked)):
                column.append(v)
            if up >= 0:
                self.kids[up].append(k)
            todo += [(y, _down(path, y), k, link) for y in reversed(x.kids) if isinstance(y, Node)]


class Matching:
    """Simple tree matching. Equal subtrees share a number; the best matching of two numbers is computed once.

    Children are matched by dynamic programming over both sequences, a numpy row at a time. Equal children at both ends are
    matched at once, which loses nothing: no other partner of the first of them can match more of it.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.best: dict[tuple[int, int], int] = {}

    def number(self, tree: Tree) -> list[int]:
        out = [0] * len(tree.sig)
        for k in range(len(out) - 1, -1, -1):
            key = (tree.sig[k], tuple(out[c] for c in tree.kids[k]))
            if key not in self.known:
                self.known[key] = len(self.label)
                self.label.append(key[0])
                self.below.append(key[1])
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            out[k] = self.known[key]
        return out

    @staticmethod
    def ends(a: tuple[int, ...] | list[int], b: tuple[int, ...] | list[int]) -> tuple[int, int]:
        """How many of the first, and then of the last, are equal."""
        most, i, j = min(len(a), len(b)), 0, 0
        while i < most and a[i] == b[i]:
            i += 1
        while j < most - i and a[-1 - j] == b[-1 - j]:
            j += 1
        return i, j

    def _table(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the distinct numbers, and which of these stand where."""
        ua, ia = np.unique(np.array(a, np.int64), return_inverse=True)
        ub, ib = np.unique(np.array(b, np.int64), return_inverse=True)
        return np.array([[self._score(x, y) for y in ub.tolist()] for x in ua.tolist()], np.int64).reshape(len(ua), len(ub)), ia, ib

    def _score(self, x: int, y: int) -> int:
        return self.size[x] if x == y else 0 if self.label[x] != self.label[y] else self.best[x, y]

    @staticmethod
    def _rows(m: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> Iterator[np.ndarray]:
        row = np.zeros(len(ib) + 1, np.int64)
        yield row
        for i in ia:
            new = np.zeros_like(row)
            new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + m[i][ib]))
            row = new
            yield row

    def score(self, a: int, b: int) -> int:
        """Nodes in the best matching of two trees; iterative, however deep these are."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if x == y or self.label[x] != self.label[y] or (x, y) in self.best:
                todo.pop()
                continue
            p, q = self.below[x], self.below[y]
            i, j = self.ends(p, q)
            mid_p, mid_q = p[i : len(p) - j], q[i : len(q) - j]
            need = [(u, v) for u in set(mid_p) for v in set(mid_q) if u != v and self.label[u] == self.label[v] and (u, v) not in self.best]
            if need:
                todo += need
                continue
            got = 1 + sum(self.size[c] for c in (*p[:i], *p[len(p) - j :]))
            if mid_p and mid_q:
                *_, row = self._rows(*self._table(mid_p, mid_q))
                got += int(row[-1])
            self.best[x, y] = got
            todo.pop()
        return self._score(a, b)

    def _align(self, m: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
        """The places that are matched. Large tables are halved at a row of the best path (Hirschberg), so that memory stays linear."""
        if not len(ia) or not len(ib):
            return []
        if len(ia) > 1 and len(ia) * len(ib) > 1 << 20:
            half = len(ia) // 2
            *_, head = self._rows(m, ia[:half], ib)
            *_, tail = self._rows(m, ia[half:][::-1], ib[::-1])
            k = int(np.argmax(head + tail[::-1]))
            return self._align(m, ia[:half], ib[:k]) + [(half + x, k + y) for x, y in self._align(m, ia[half:], ib[k:])]
        rows, out = list(self._rows(m, ia, ib)), []
        i, j = len(ia), len(ib)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out[::-1]

    def pairs(self, a: Tree, na: list[int], b: Tree, nb: list[int]) -> Iterator[tuple[int, int]]:
        """The matched nodes of two trees, by their places."""
        self.score(na[0], nb[0])
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            yield x, y
            p, q = a.kids[x], b.kids[y]
            u, v = [na[c] for c in p], [nb[c] for c in q]
            i, j = self.ends(u, v)
            todo += list(zip(p[:i], q[:i], strict=True)) + list(zip(p[len(p) - j :], q[len(q) - j :], strict=True))
            mid = (u[i : len(u) - j], v[i : len(v) - j])
            if all(mid):
                for s in set(mid[0]):
                    for t in set(mid[1]):
                        self.score(s, t)
                m, ia, ib = self._table(*mid)
                todo += [(p[i + s], q[i + t]) for s, t in self._align(m, ia, ib) if m[ia[s], ib[t]] > 0]


def container(trees: list[Tree], template: set[str] | frozenset[str] = frozenset()) -> str:
    """The path of the deepest block that occurs once a page and holds SHARE of the varying text outside links; a marked one needs MARKED of it.

    A marked one comes first; inside it another needs half. Of a single tree, which shows no variation, only a marked one counts.
    """
    mass: Counter[str] = Counter()
    seen: dict[str, tuple[str, str, bool]] = {}
    most: Counter[str] = Counter()
    for t in trees:
        sums = [0 if d in template else n for d, n in zip(t.text, t.size, strict=True)]
        here: Counter[str] = Counter(t.path)
        for k in range(len(sums) - 1, 0, -1):
            sums[t.up[k]] += sums[k]
            mass[t.path[k]] += sums[k]
            if t.path[k] not in seen:
                seen[t.path[k]] = t.path[t.up[k]], t.tag[k], t.marked[k]
        mass[""] += sums[0] if sums else 0
        for path, n in here.items():
            most[path] = max(most[path], n)
    below: dict[str, list[str]] = defaultdict(list)
    for path, (up, _, _) in seen.items():
        below[up].append(path)
    if not mass[""]:
        return ""

    def under(path: str, top: str) -> bool:
        while path and path != top:
            path = seen[path][0]
        return path == top

    at, least = "", MARKED
    while top := max((p for p in seen if seen[p][2] and p != at and under(p, at) and mass[p] >= least * mass[at]), key=lambda p: (mass[p], p), default=""):
        at, least = top, 0.5
    while len(trees) > 1 and not (at and seen[at][2]):
        fit = [p for p in below[at] if seen[p][1] in BLOCK and seen[p][1] not in PARTS and most[p] == 1]
        top = max(fit, key=lambda p: (mass[p], p), default=None)
        if top is None or mass[top] < SHARE * mass[""]:
            break
        at = top
    return at


def _inside(tree: Tree, path: str) -> list[bool]:
    """Which nodes are at a path or below."""
    out: list[bool] = []
    for k, p in enumerate(tree.path):
        out.append(p == path or (k > 0 and out[tree.up[k]]))
    return out


def _voters(trees: list[Tree]) -> list[Tree]:
    """The trees without copies: the first of those that share half of their marked-up article or, without one, all text."""
    path = container(trees)
    marked = any(m for t in trees for p, m in zip(t.path, t.marked, strict=True) if p == path)
    out: list[Tree] = []
    texts: list[set[str]] = []
    for t in trees:
        mine = {d: n for d, n, inside in zip(t.text, t.size, _inside(t, path if marked else ""), strict=True) if d and inside}
        least = 0.5 if marked else 1.0
        if not any(sum(n for d, n in mine.items() if d in other) >= max(1, least * sum(mine.values())) for other in texts):
            out.append(t)
            texts.append(set(mine))
    return out


def induce(pages: list[str]) -> str | None:
    """The wrapper of pages of one host, as JSON: container (the digest of a path of kinds) and the template inside it (digests of path and text)."""
    trees = [t for t in (Tree(shrunk(parse(p))) for p in pages) if any(t.size)]
    if len(trees) < 2:
        return None
    voters, template = _voters(trees), set()
    if len(voters) >= VOTES:
        match = Matching()
        numbers = [match.number(t) for t in voters]
        total = [sum(match.score(*sorted((a[0], b[0]))) / (len(a) + len(b)) for b in numbers) for a in numbers]
        centre = max(range(len(voters)), key=lambda k: total[k])
        ref, equal = voters[centre], Counter(k for k, d in enumerate(voters[centre].text) if d)
        for k, t in enumerate(voters):
            if k != centre:
                equal.update(x for x, y in match.pairs(ref, numbers[centre], t, numbers[k]) if ref.text[x] and ref.text[x] == t.text[y])
        template = {ref.text[x] for x, n in equal.items() if n >= VOTES and 3 * n >= 2 * len(voters)}
    path = container(voters, template)
    held = {d for t in voters for d, inside in zip(t.text, _inside(t, path), strict=True) if inside}
    return json.dumps({"container": path, "template": sorted(template & held)})


@functools.lru_cache(256)
def _read(wrapper: str) -> tuple[str, frozenset[str]]:
    w = json.loads(wrapper)
    return w["container"], frozenset(w["template"])


def _at(root: Node, path: str) -> list[tuple[Node, str]]:
    """The nodes at a path, none inside another, in page order."""
    out, todo = [], [(root, "")]
    while todo:
        x, here = todo.pop()
        if here == path:
            out.append((x, here))
        else:
            todo += [(k, _down(here, k)) for k in reversed(x.kids) if isinstance(k, Node)]
    return out


def extract(page: str | None, wrapper: str | None = None) -> str:
    if not page:
        return ""
    root = shrunk(parse(page))
    if wrapper:
        path, template = _read(wrapper)
        if text := _text(_at(root, path), template):
            return text
    return _text(_at(root, container([Tree(root)])), frozenset())


def _text(chosen: list[tuple[Node, str]], template: frozenset[str]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    # depth first without recursion: documents may nest deeply
    steps: list[tuple[Node | str | None, str]] = []
    for x, path in reversed(chosen):
        steps += [(None, ""), (x, path)]
    while steps:
        x, path = steps.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        else:
            fixed = bool(template and (own := x.own()) and _digest(path, own) in template)
            if x.tag == "br":
                line.append(" ")
            if x.tag in BLOCK:
                flush()
                steps.append((None, ""))
            # of a template node its own text goes, the slots inside stay
            kids = [" " if fixed and isinstance(k, str) else k for k in reversed(x.kids)]
            steps += [(k, _down(path, k) if template and isinstance(k, Node) else "") for k in kids]
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper: of hosts with two sampled pages at least. The first pass reads only URLs."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(url_col).alias("pick"), F.col(html_col).alias("html")).where("host != ''")
    rows = rows.withColumn("bucket", F.pmod("pick", F.lit(SAMPLE)))
    picks = stored(rows.groupBy("host", "bucket").agg(F.min("pick").alias("pick")), "html-picks")
    sample = rows.join(sized(picks), ["host", "bucket", "pick"]).groupBy("host", "bucket").agg(F.min("html").alias("html"))

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["html"]).sort_values("bucket")
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [induce(group["html"].tolist())][: len(group)]})

    return stored(sample.groupBy("host").applyInPandas(learn, "host string, wrapper string").where("wrapper is not null"), "html-wrappers")


@shielded
def extracted(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text and n_chars instead of columns of that name, and without their html.

    Wrappers are broadcast if their bytes, summed, are few; else pages meet them by (host, run), which spreads a large host.
    """
    bounded_batches(pages.sparkSession)
    learned = wrappers(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    total = learned.agg(F.sum(F.octet_length("__wrapper") + F.octet_length("__host") + 64).alias("n")).first()["n"] or 0

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for source, wrapper in batches:
            yield pa.array([extract(s.as_py(), w.as_py()) for s, w in zip(source, wrapper, strict=True)], pa.string())

    rows = pages.withColumn("__host", host_of(F.col(url_col)))
    if total <= WRAPPER_BYTES:
        rows = rows.join(F.broadcast(learned), "__host", "left")
    else:
        rows = attach(rows.withColumn("__run", row_salt(pages, html_col)), learned, ["__host"], "__run")
    rows = rows.withColumn("__text", F.arrow_udf(run, "string")(F.col(html_col), F.col("__wrapper")))
    new = ("text", "n_chars", html_col)
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c not in new], F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
