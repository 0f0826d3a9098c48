"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into text blocks with the elements they lie in. A classifier prices each block as content and as
boilerplate from its words, sentences and links, the zone it lies in and the names of that zone; no single name decides.
The prices are the capacities of its edges to the two terminals. Blocks that follow one another, and blocks that are near one
another in the element tree, are joined by smoothness edges. The minimum cut separates content from boilerplate at the
least total price.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

# Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("template noscript svg select option button object canvas video audio".split())  # what they hold is no text of the page
RAW_TEXT = frozenset("script style textarea title iframe".split())  # without an end tag they go on to the page's end
ALONE = frozenset("option button select".split())  # the next of their kind ends them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("caption dd dt html body head li td th tr tbody thead tfoot legend summary figcaption".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table article section div body aside nav header footer main form".split())
DEEPEST = 512  # elements below stay with the one at this depth, as browsers have it

# Words that page authors name the surroundings of an article by, words that go with them in a name, and words
# for what readers add.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertorial banner sponsor sponsored sponsors promo promotion promotions nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended popular trending widget widgets toolbar pagination pager skip copyright disclaimer byline search poll survey paywall".split())
BESIDE = frozenset("site main page top bottom left right global primary secondary post article entry area list bar box container wrapper wrap inner block links link buttons button "
                   "posts articles stories items unit slot section nav form col column row text message bg fixed sticky mobile desktop".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
INSIDE = frozenset("article articlebody content maincontent main post entry story prose markdown".split())
OUT_TAGS = frozenset("nav aside footer menu dialog search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# What notices say.
_CUES = re.compile(r"(?i)\b(?:cookies?|subscribe|newsletter|sign up|log in|all rights reserved|privacy policy|terms of (?:use|service))\b")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
TAG_COST, NAME_COST, MORE_COST, FORM_COST, READERS_COST, HIDDEN_COST = 3.4, 3.0, 0.4, 2.4, 4.5, 8.0


def _named(names: list[str]) -> tuple[int, bool, bool]:
    """How many of an element's names say that it lies outside an article, whether one is the readers', whether one is an article's.

    A name counts only whole: "site-footer" is made of such words alone, "with-sidebar" and "tag-menu-design" aren't.
    """
    outside, readers, inside = 0, False, False
    for name in names:
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words:
            continue
        rest = [w for w in words if w not in BESIDE]
        if rest and all(w in READERS for w in rest):
            readers = True
        elif rest and all(w in OUTSIDE for w in rest) and (len(words) == 1 or words[-1] != "page"):
            outside += 1
        elif all(w in INSIDE or w in ("body", "text", "area", "main") for w in words) and any(w in INSIDE for w in words):
            inside = True
    return outside, readers, inside


class Element:
    """A block-level element: the zone it lies in (the element that was last priced as boilerplate), whether inside an article."""

    __slots__ = ("tag", "parent", "depth", "zone", "outer", "cost", "readers", "inside", "head")

    def __init__(self, tag: str, parent: Element | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.zone, self.inside = (parent.zone, parent.inside) if parent else (None, 0.0)
        self.readers, self.cost, self.outer = bool(parent and parent.readers), 0.0, None
        self.head = tag == "head" or bool(parent and parent.head)
        names, role, hidden = [], "", False
        if attrs:
            for m in _ATTR.finditer(attrs):
                k, v = m[1].lower(), (m[2] or "").strip("\"'")
                if k in ("class", "id"):
                    names += v.split()
                elif k == "role":
                    role = v.lower()
                elif k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and _HIDDEN.search(v):
                    hidden = True
        outside, readers, good = _named(names) if names and tag not in ("html", "body") else (0, False, False)
        article = (tag in ("article", "main") or role in ("main", "article")) and not readers
        cost = 0.0
        if readers and not (tag == "main" or article):
            cost, self.readers = READERS_COST, True
        if not article:
            if outside:
                cost = max(cost, NAME_COST + MORE_COST * (outside > 1))
            if tag in OUT_TAGS or role in OUT_ROLES or tag == "header" and not self.inside:
                cost = max(cost, TAG_COST) + MORE_COST * (outside > 0)
            if tag == "form" or role == "form":
                cost = max(cost, FORM_COST)
        if hidden:
            cost = HIDDEN_COST
        if article and not self.readers:  # what surrounds an article has no bearing on it
            self.zone, self.inside = None, 1.6
        elif good and not cost:
            self.inside = max(self.inside, 0.8)
        if cost:
            self.outer, self.zone, self.cost, self.inside = self.zone, self, cost, 0.0


class Block:
    __slots__ = ("text", "element", "linked", "tag", "words", "share")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked, self.tag = text, element, linked, element.tag
        self.words = text.count(" ") + 1
        self.share = linked / len(text)


def _tokens(page: str) -> list[tuple]:
    """(start, end, name, is an end tag, attributes) of every tag, and (start, end, None, False, text) of the rest that is no text."""
    out, at, closed = [], 0, page.rfind(">") + 1  # no tag ends after it
    while m := _TOKEN.search(page, at, max(at, closed)):
        at = m.end()
        if m[2] is None:
            out.append((m.start(), at, None, False, m[0][9:-3] if m[0].startswith("<![CDATA[") else ""))
            continue
        tag = m[2].lower()
        if tag in RAW_TEXT and not m[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append((m.start(), at, None, False, ""))
        else:
            out.append((m.start(), at, tag, bool(m[1]), m[3]))
    if (tail := page.find("<!--", closed)) >= 0:
        out.append((tail, len(page), None, False, ""))
    return out


def _skips(tokens: list[tuple]) -> dict[int, int]:
    """For the start tags of skipped elements, by token, where what they hold ends: after their end tag; an option without
    one where the next option or its parent's end tag begins; others without one hold nothing."""
    out: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    count: Counter = Counter()

    def closed(at: int, end: int, own: bool) -> None:
        """Closes open_[at] and what is above it; only open_[at] has an end tag of its own, if any."""
        for k in range(len(open_) - 1, at - 1, -1):
            tag, i = open_.pop()
            count[tag] -= 1
            if tag in SKIPPED and (own and k == at):
                out[i] = end
            elif tag == "option":
                out[i] = tokens[now][0]

    for now, (_, end, tag, is_end, attrs) in enumerate(tokens):
        if tag is None or tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if is_end:
            if count[tag]:
                closed(max(k for k in range(len(open_)) if open_[k][0] == tag), end, True)
            continue
        kinds = {"option", "optgroup"} if tag == "optgroup" else {tag}
        if tag in ALONE or tag == "optgroup":
            for kind in kinds & ALONE:
                if count[kind]:
                    closed(max(k for k in range(len(open_)) if open_[k][0] == kind), tokens[now][0], False)
        if (tag in SKIPPED or tag in BLOCKS or tag in ("datalist", "optgroup")) and len(open_) < DEEPEST:
            open_.append((tag, now))
            count[tag] += 1
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: decoded, white space runs made one space, without what scripts, styles and heads hold.

    Inline elements part no blocks; of them only links are followed. Time is linear in the page.
    """
    out: list[Block] = []
    tokens = _tokens(page)
    skips = _skips(tokens)
    stack = [Element("#", None, "")]
    count: Counter = Counter()
    text: list[str] = []
    linked, in_link, own, at = 0, False, stack[0], 0

    def flush() -> None:
        nonlocal linked
        if text:
            t = " ".join(html.unescape("".join(text)).split())
            if t and not own.head:
                out.append(Block(t, own, min(linked, len(t))))
            text.clear()
        linked = 0

    def close(i: int) -> None:
        for e in stack[i:]:
            count[e.tag] -= 1
        del stack[i:]

    def nearest(tags: set[str]) -> int:
        """Where the innermost of these elements lies, not looking out of the innermost scope; 0 if there is none."""
        if any(count[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return i
                if stack[i].tag in SCOPES:
                    break
        return 0

    for i, (start, end, tag, is_end, attrs) in enumerate([*tokens, (len(page), len(page), None, False, "")]):
        if start < at:
            continue
        if start > at:
            if not text:
                own = stack[-1]
            chunk = page[at:start]
            text.append(chunk)
            if in_link:
                linked += len(chunk.strip())
        at = end
        if tag is None:
            if attrs:
                text.append(attrs)
            continue
        if tag == "a":
            in_link = not is_end
        elif tag == "br":
            text.append(" ")
        elif tag in SKIPPED:
            at = skips.get(i, end) if not is_end else end
        elif tag not in BLOCKS:
            continue
        elif is_end:
            flush()
            if count[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in SCOPES and tag not in SCOPES:
                        break
        else:
            flush()
            if tag in CLOSES_P and (k := nearest({"p"})):
                close(k)
            if tag in SAME and (k := nearest(SAME[tag])):
                close(k)
            if tag not in VOID and len(stack) < DEEPEST:
                stack.append(Element(tag, stack[-1], attrs))
                count[tag] += 1
    flush()
    return out


_SENTENCE = re.compile(r"[.!?…。！？,;:]")


def _wrappers(found: list[Block]) -> set[Element]:
    """Priced elements that hold most of a page's text and long paragraphs, while no article lies outside them: a form or a
    box round the whole page."""
    total = sum(len(b.text) - b.linked for b in found)
    held, long, inside = Counter(), Counter(), Counter()
    for b in found:
        z = b.element.zone
        while z is not None:
            held[z] += len(b.text) - b.linked
            long[z] += b.words >= 25 and b.share < 0.3
            inside[z] += b.element.inside > 0
            z = z.outer
    articles = sum(b.element.inside > 0 for b in found)
    return {z for z in held if z.cost < HIDDEN_COST and held[z] > 0.6 * total and long[z] >= 2 and inside[z] == articles}


def score(b: Block, wrappers: set[Element] | frozenset = frozenset()) -> float:
    """Log odds that a block is content, from its words, sentences and links, its zone and whether it lies in an article."""
    cost, z = 0.0, b.element.zone
    while z is not None:
        cost = max(cost, z.cost * (0.2 if z in wrappers else 1.0))
        z = z.outer
    s = -0.5 + min(2.2, 0.9 * math.log1p(b.words) - 1.4)
    s += 0.6 * (len(_SENTENCE.findall(b.text)) >= 2) + 0.3 * (b.text[-1] in ".!?…:\"'")
    s -= 4.0 * b.share
    heading = b.tag[0] == "h" and b.tag[1:].isdigit()
    s += 0.5 * (b.tag in ("p", "blockquote", "pre") or heading) + b.element.inside + 0.4 * (heading and b.element.inside > 0)
    s -= cost + 1.2 * ("©" in b.text) + 0.8 * (b.words < 60 and _CUES.search(b.text) is not None)
    return max(-8.0, min(8.0, s))


def minimum_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each of n nodes whether it stays with the source at the least cut, by shortest augmenting levels.

    A node whose terminal edges differ by more than all its smoothness edges together has its side settled beforehand.
    """
    side: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    d = [s - t for s, t in zip(source, sink)]
    slack = [sum(w for _, w in x) for x in near]
    settled = deque(i for i in range(n) if abs(d[i]) >= slack[i])
    while settled:
        i = settled.popleft()
        if side[i] is not None:
            continue
        side[i] = d[i] >= 0
        for j, w in near[i]:
            if side[j] is None:
                d[j] += w if side[i] else -w
                slack[j] -= w
                if abs(d[j]) >= slack[j]:
                    settled.append(j)
    free = [i for i in range(n) if side[i] is None]
    if not free:
        return [bool(x) for x in side]
    at = {i: k + 2 for k, i in enumerate(free)}
    graph: list[list[list]] = [[] for _ in range(len(free) + 2)]

    def join(a: int, b: int, c: float, back: float) -> None:
        graph[a].append([b, c, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i in free:
        if d[i] > 0:
            join(0, at[i], d[i], 0.0)
        elif d[i] < 0:
            join(at[i], 1, -d[i], 0.0)
    for a, b, w in edges:
        if a in at and b in at:
            join(at[a], at[b], w, w)
    while True:
        level = [-1] * len(graph)
        level[0] = 0
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for v, c, _ in graph[u]:
                if c > 1e-9 and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[1] < 0:
            break
        turn = [0] * len(graph)
        path: list[tuple[int, int]] = []
        u = 0
        while True:
            if u == 1:
                flow = min(graph[a][k][1] for a, k in path)
                for a, k in path:
                    e = graph[a][k]
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                path, u = [], 0
                continue
            while turn[u] < len(graph[u]):
                v, c, _ = graph[u][turn[u]]
                if c > 1e-9 and level[v] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(graph[u]):
                path.append((u, turn[u]))
                u = graph[u][turn[u]][0]
            elif path:
                u = path.pop()[0]
                turn[u] += 1
            else:
                break
    for i in free:
        side[i] = level[at[i]] >= 0
    return [bool(x) for x in side]


FOLLOWS, SIBLING, UNCLE, ACROSS = 2.6, 1.2, 0.6, 0.15


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the text (weaker the farther apart in the tree), between successive children of an element
    and to the child before the parent's element; little binds blocks of different zones."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a, c, steps = found[i - 1].element, b.element, 0
            while a is not c:
                if a.depth >= c.depth:
                    a = a.parent
                else:
                    c = c.parent
                steps += 1
            edges.append((i - 1, i, FOLLOWS / (1 + steps) * (1.0 if found[i - 1].element.zone is b.element.zone else ACROSS)))
        up = b.element.parent
        for e, w in ((up, SIBLING), (up and up.parent, 0 if up in last else UNCLE)):  # only a parent's first block meets its uncle
            if w and e in last:
                edges.append((last[e], i, w * (1.0 if found[last[e]].element.zone is b.element.zone else ACROSS)))
        last[up] = i
    return edges


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    wrappers = _wrappers(found)
    z = [score(b, wrappers) for b in found]
    cost = [(math.log1p(math.exp(-x)), math.log1p(math.exp(x))) for x in z]  # as content, as boilerplate
    keep = minimum_cut(len(found), [c[1] for c in cost], [c[0] for c in cost], smoothness(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches):
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null and empty html give an empty text, as does a page without content blocks. Null and repeated ids keep their rows,
    an empty table gives none, other columns are not read.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
