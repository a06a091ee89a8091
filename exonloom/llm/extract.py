"""Main text of HTML pages by scoring the tree of their blocks.

A page becomes a tree of block elements with runs of text between.  Every paragraph passes points for
its length and its commas to its parent and half of them to the element above; an element's points are
discounted by the share of its text that is inside links.  The best element and those of its siblings
that read like text are kept, and menus, forms, adverts and the like inside them are left out.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element and class names with a meaning here (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("head nav header footer aside form menu dialog title fieldset search".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted "
    "related replies respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
PARAGRAPHS = frozenset("p pre td blockquote dd".split())
KEPT_WHOLE = frozenset("html body article main".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 head title".split())
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z",
    re.S,
)
# Elements dropped with all that is in them; the first three also where they are never closed (fixed names).
NEVER_OPEN = frozenset("script style textarea".split())
DROPPED = NEVER_OPEN | frozenset("noscript template svg iframe select button object canvas math".split())
CLOSE = {n: re.compile(rf"</{n}\s*>", re.I) for n in DROPPED}
ANY_CLOSE = re.compile(r"</(" + "|".join(sorted(DROPPED)) + r")\s*>", re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "parent", "depth", "junk", "hard", "unlikely", "points", "chars", "linked", "paragraph", "kept")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.depth = 0 if parent is None else parent.depth + 1
        self.points, self.chars, self.linked, self.paragraph, self.kept = 0.0, 0, 0, False, False
        names = {w for m in NAMES.finditer(attributes) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())}
        hard = tag in BOILERPLATE or tag not in KEPT_WHOLE and bool(attributes and HIDDEN.search(attributes))
        self.hard = hard or parent is not None and parent.hard
        self.unlikely = tag not in KEPT_WHOLE and bool(names & UNLIKELY)
        self.junk = self.hard or self.unlikely or parent is not None and parent.junk

    def chain(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent


class Open:
    """The elements open at a place of the page: the innermost, and by name all from the outermost in."""

    def __init__(self, root: Node):
        self.now, self.by_tag = root, defaultdict(list)

    def push(self, node: Node) -> None:
        self.now = node
        self.by_tag[node.tag].append(node)

    def close(self, node: Node) -> None:
        """Close ``node`` and all inside it."""
        while self.now is not node.parent:
            self.by_tag[self.now.tag].pop()
            self.now = self.now.parent

    def close_same(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the outermost element of these names that is inside the innermost of ``within``."""
        least = max((self.by_tag[t][-1].depth for t in within if self.by_tag[t]), default=-1)
        first = [x[i] for t in tags if (x := self.by_tag[t]) and (i := bisect_right(x, least, key=lambda n: n.depth)) < len(x)]
        if first:
            self.close(min(first, key=lambda n: n.depth))


SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


def dropped_to(page: str, start: int, name: str, after_name: int, last_close: dict[str, int]) -> int:
    """Where a dropped element that opens at ``start`` ends; -1 if it is a mere tag."""
    end = page.find(">", start) + 1
    if not end or page[after_name] not in " \t\n\r\f\v/>":
        return -1
    if name in ("svg", "math") and page[end - 2] == "/":
        return end
    if last_close.get(name, -1) >= end:  # one search then finds it, and the search for the next begins behind it
        return CLOSE[name].search(page, end).end()
    return len(page) if name in NEVER_OPEN else -1


def tree(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All elements, parents first, and the blocks of text in page order: element, clean text, characters inside links."""
    root = Node("", None)
    nodes, opened = [root], Open(root)
    blocks, run, linked, in_link, last = [], [], 0, False, 0
    last_close = {m[1].lower(): m.start() for m in ANY_CLOSE.finditer(page)}

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                blocks.append((opened.now, text, min(linked, len(text))))
            run.clear()
        linked = 0

    while (m := MARKUP.search(page, last)) is not None:
        if m.start() > last:
            run.append(page[last : m.start()])
            linked += in_link * (m.start() - last)
        last = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in DROPPED and not closing:
            end = dropped_to(page, m.start(), tag, m.end(2) if m[2] else m.end(5), last_close)
            if end >= 0:
                last = end
                continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            run.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                if opened.by_tag[tag]:
                    opened.close(opened.by_tag[tag][-1])
                in_link = False
                continue
            if tag in CLOSED_BY_SAME:
                opened.close_same(SAME.get(tag, (tag,)), CLOSED_BY_SAME[tag])
            while opened.now.tag in CLOSED_BY_BLOCK and not (opened.now.tag == "head" and tag == "title"):
                opened.close(opened.now)
            if tag != "hr":
                nodes.append(Node(tag, opened.now, m[3] or m[6] or ""))
                opened.push(nodes[-1])
                in_link = False
    if last < len(page):
        run.append(page[last:])
        linked += in_link * (len(page) - last)
    flush()
    return nodes, blocks


def spare(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Names do not count on the way to the element with most paragraph points."""
    points, holders = {}, {}
    for node, text, linked in found:
        if not node.hard and len(text) >= 25 and 2 * linked < len(text):
            holder = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
            holders[id(holder)] = holder
            points[id(holder)] = points.get(id(holder), 0) + 1 + text.count(",") + min(len(text) / 100, 3)
    best = max(points, key=lambda i: (points[i], not holders[i].junk), default=None)
    if best is None or not holders[best].junk:
        return
    for n in holders[best].chain():
        n.unlikely = False
    for n in nodes:
        n.junk = n.hard or n.unlikely or n.parent is not None and n.parent.junk


def main_text(page: str | None) -> str:
    """The main text of one page: its blocks in order, joined by a space; null or none: empty."""
    nodes, found = tree(page or "")
    spare(nodes, found)
    blocks = [(n, text, linked) for n, text, linked in found if not n.junk]
    if not blocks:
        return ""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if len(text) < 25 or node.tag[:1] == "h" and node.tag[1:].isdigit():
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        holder = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        node.paragraph = True
        holder.points += points
        if holder.parent is not None:
            holder.parent.points += points / 2
    for n in reversed(nodes):  # children before parents
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    every: dict[int, Node] = {}  # elements with text in them, from each block outwards
    for node, _, _ in blocks:
        for n in node.chain():
            if id(n) in every:
                break
            every[id(n)] = n
    density = lambda n: n.linked / max(n.chars, 1)
    score = lambda n: n.points * (1 - density(n))
    best = max(every.values(), key=score)
    if score(best) <= 0:  # no paragraph: the first article, else all that is left
        best = next((n for n in every.values() if n.tag in ("article", "main")), nodes[0])
    for n in best.chain():
        if n.tag in ("article", "main"):
            best = n  # a part of an article stands for the whole of it
    least = max(10.0, 0.2 * score(best))

    def kept(n: Node) -> bool:
        if n is best:
            return True
        if n.parent is not best.parent or best.parent is None:
            return False
        if n.tag == "p":
            return n.chars > 80 and density(n) < 0.25 or not n.linked and n.paragraph
        return n.tag not in ("ul", "ol") and score(n) >= least

    for n in nodes:
        n.kept = n.parent is not None and n.parent.kept or kept(n)
    return " ".join(text for node, text, _ in blocks if node.kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text`` and ``n_chars`` (code points).

    The whole page is read.  Null or empty pages, and pages without text, give an empty text.  Repeated rows
    stay; columns called ``text`` or ``n_chars`` are replaced; an empty table gives an empty result.
    Each page is worked on by itself, so there is no shuffle.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType(
        [*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            made = [main_text(x.as_py()) for x in batch.column(html)]
            columns = [*[batch.column(c) for c in keep], pa.array(made, pa.string()), pa.array(map(len, made), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html)).mapInArrow(run, schema)
