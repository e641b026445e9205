"""Main text of web pages by tree scoring.

A page's tags are read once into a tree of block containers, in time linear in its length.  Paragraph blocks give points for length and
commas to their container, and half of what a container has goes on to the one above, up to the root; a container's value is its points
discounted by its link density, by class words that speak against it, and doubled for article and main.

The best container by value is the start.  If an article or main holds it, that (the nearest) is kept; else the containers above it are
climbed, and each whose other text has CLIMB of the points kept so far takes its place.  In a kept container that is no article, plain containers
(div, section, ...) of under SHARE of the worth of the best of them are left out before the first and after the last part of worth, where worth is
the value without the halving.  Siblings of the kept container stay if they have SHARE of its worth and few links; so do paragraphs of some length beside it, and the heading right before it.
Blocks that are mostly links in a container that is mostly links are left out.

Menus, headers, footers, sidebars, forms, scripts and styles by tag or role never enter the tree.  A class or id counts as a whole (ad, ad-box, not
form-of-government).  One of FOREIGN takes its element out; one of DOUBTFUL halves its value, and takes it out where that leaves hardly any.  No class
takes out what holds most of the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "head", "title", "template", "iframe", "svg", "button", "select", "textarea", "input", "menu", "dialog", "object", "canvas", "math", "noembed", "noframes", "xmp", "map", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dt", "dd", "figcaption", "caption", "summary", "address"}
CONTAINERS = {"html", "body", "div", "article", "section", "main", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "header", "hgroup", "details", "fieldset", "center", "nav", "footer", "aside", "form"}
#: What an open element ends when another begins.
CLOSES_P = BLOCKS - {"td", "th", "caption", "figcaption", "summary"} | CONTAINERS | {"hr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form", "alertdialog", "status"}
#: Words of class or id of what is no part of an article.
FOREIGN = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "sidebar", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "disqus", "reply", "replies", "respond",
    "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "related", "recommended", "widget", "pagination", "pager", "toolbar", "skip", "toast",
}
#: Words that may mark either.
DOUBTFUL = {"alert", "notice", "form", "legal", "disclaimer", "search", "header", "banner", "social"}
UNLIKELY = FOREIGN | DOUBTFUL
#: Words that say nothing of their own beside those.
NEUTRAL = {
    "box", "bar", "area", "block", "wrap", "wrapper", "container", "section", "list", "item", "items", "inner", "outer", "top", "bottom", "left", "right", "site",
    "page", "main", "global", "primary", "secondary", "links", "link", "buttons", "button", "icons", "icon", "panel", "unit", "slot", "zone", "row", "col", "module",
}
#: Those of them that even an article element may be marked with.
READERS = {"comment", "comments", "disqus", "reply", "replies", "respond", "ad", "ads", "advert", "related"}
#: With one of these a class tells of the layout (no-sidebar, has-sidebar), not of the element.
LAYOUT = {"no", "not", "non", "has", "with", "without", "hide", "show"}
NAME_PART = re.compile(r"[A-Za-z]+")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
SPACE = re.compile(r"\s+")


#: Points that other text needs, of those kept, for a container to be climbed to; and worth that a sibling needs, of the kept one's.
CLIMB, SHARE = 0.3, 0.2
#: Value under which a doubtful container, and a doubtful block, is left out; characters of a doubtful element within a block.
LOW_CONTAINER, LOW_BLOCK, LOW_CHARS = 2.0, 0.6, 20
#: Characters and points of a paragraph that stays beside the kept container.
BESIDE_CHARS, BESIDE_POINTS = 80, 2.0
#: What a score decides on; lists, tables and figures belong to the text around them.
PLAIN = {"div", "section", "center", "fieldset", "header"}
ENDS = tuple(".!?\u2026\u3002\uff01\uff1f\"\u201d\u00bb)")


class Linked(str):
    """A block that is mostly links."""


class Heading(str):
    """A block that is a heading of the first two ranks."""


def points_of(block: str, linked: int = 0) -> float:
    return (1 + block.count(",") + min(len(block) / 100, 3)) * (1 - linked / len(block))


class Box:
    """A container: its blocks and inner containers in page order; ``held``, ``all_points`` and ``all_linked`` count what is in it, ``articles`` the article and
    main elements, and size, linked, points and raw (points without the halving) leave out what is out."""

    __slots__ = ("tag", "parent", "parts", "marks", "held", "all_points", "all_linked", "articles", "out", "size", "linked", "points", "raw")

    def __init__(self, tag: str, parent: Box | None, marks: frozenset[str] | set[str] = frozenset()):
        self.tag, self.parent, self.marks, self.parts = tag, parent, marks, []
        self.held = self.all_linked = self.articles = self.size = self.linked = 0
        self.all_points = self.points = self.raw = 0.0
        self.out = False

    def add(self, block: str, linked: int, heading: bool = False) -> None:
        n, points = len(block), points_of(block, linked)
        self.parts.append(Linked(block) if 2 * linked > n else Heading(block) if heading else block)
        self.held, self.all_linked, self.all_points = self.held + n, self.all_linked + linked, self.all_points + points
        self.size, self.linked, self.points, self.raw = self.size + n, self.linked + linked, self.points + points, self.raw + points

    @property
    def is_shell(self) -> bool:
        return self.tag in ("article", "main")

    @property
    def value(self) -> float:
        if not self.size:
            return 0.0
        return self.points * (1 - self.linked / self.size) * (2 if self.is_shell else 1) * (0.5 if self.marks else 1)

    @property
    def worth(self) -> float:
        """The value without the halving on the way up, to compare containers of any depth."""
        return self.raw * (1 - self.linked / self.size) * (0.5 if self.marks else 1) if self.size else 0.0

    @property
    def is_low(self) -> bool:
        """Whether its marks, doubtful ones, leave hardly any value."""
        return not self.held or 0.5 * self.all_points * (1 - self.all_linked / self.held) < (LOW_CONTAINER if self.tag in CONTAINERS else LOW_BLOCK)


def weigh(boxes: list[Box]) -> None:
    """Sums over the containers, listed from the root down: all that they hold, who is out, and then points of what is in."""
    for b in reversed(boxes[1:]):
        up = b.parent
        up.held, up.all_points, up.all_linked, up.articles = up.held + b.held, up.all_points + b.all_points, up.all_linked + b.all_linked, up.articles + b.articles + b.is_shell
    held, articles = boxes[0].held, boxes[0].articles
    for b in boxes[1:]:
        most = 2 * b.held > held and (not articles or (b.articles + b.is_shell and not b.marks & READERS))
        b.out = b.parent.out or bool(b.marks and not most and (b.marks & FOREIGN or b.is_low))
    for b in reversed(boxes[1:]):
        if not b.out:
            up = b.parent
            up.size, up.linked, up.points, up.raw = up.size + b.size, up.linked + b.linked, up.points + b.points / 2, up.raw + b.raw


def unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all in it is left out; a header within an article may hold its heading and stays."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def marked(tag: str, attributes: str, in_article: bool) -> set[str]:
    """The words of class and id that mark an element as no part of an article, of names that have no other word."""
    found: set[str] = set()
    if "=" in attributes and tag not in ("body", "html", "main"):
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id"):
                for token in value.strip("\"'").lower().split():
                    words = set(NAME_PART.findall(token))
                    if not words & LAYOUT and words <= UNLIKELY | NEUTRAL:
                        found |= words & (READERS if tag == "article" else UNLIKELY)
    return found - ({"header"} if in_article else set())


def extents(page: str) -> tuple[dict[int, tuple[int, bool]], int, bool]:
    """By the place after each start tag, the characters of text in the element and whether an article or main is in it; and both for the page."""
    held: dict[int, tuple[int, bool]] = {}
    opened: dict[str, list[tuple[int, int, int]]] = {}
    at, chars, articles = 0, 0, 0
    while m := TAG.search(page, at):
        chars += len("".join(page[at : m.start()].split()))
        at = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            if opened.get(tag):
                lo, n, k = opened[tag].pop()
                held[lo] = (chars - n, articles > k)
        elif tag in DROPPED:
            at = past(page, at, tag, m[0].endswith("/>"))
        elif tag and tag not in VOID:
            opened.setdefault(tag, []).append((at, chars, articles))
            articles += tag in ("article", "main")
    chars += len("".join(page[at:].split()))
    for lo, n, k in (x for rest in opened.values() for x in rest):
        held[lo] = (chars - n, articles > k)
    return held, chars, articles > 0


class Open:
    """The open elements.  Places of each tag, of blocks and containers and of containers alone are kept apart, so no question walks the stack."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, Box] | None] = []
        self.places: dict[str, list[int]] = {}
        self.solid: list[int] = []
        self.boxes: list[int] = []

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, box: Box) -> None:
        k = len(self.tags)
        self.tags.append((tag, box))
        self.places.setdefault(tag, []).append(k)
        if tag in CONTAINERS or tag in BLOCKS:
            self.solid.append(k)
        if tag in CONTAINERS:
            self.boxes.append(k)

    def pop(self) -> tuple[str, Box] | None:
        """Takes the last place off; None if its element has ended before."""
        k, item = len(self.tags) - 1, self.tags.pop()
        if item:
            self.places[item[0]].pop()
            for kept in (self.solid, self.boxes):
                if kept and kept[-1] == k:
                    kept.pop()
        return item

    def end(self, k: int) -> None:
        """Ends an element inside others that stay open: its place becomes empty."""
        if k == len(self.tags) - 1:
            self.pop()
        else:
            self.places[self.tags[k][0]].pop()
            self.tags[k] = None


def tree(page: str) -> list[Box]:
    """The page's containers, from the root on in page order.  Unclosed elements end with their container, stray ends are passed over."""
    box = Box("html", None)
    boxes, opened = [box], Open()
    text: list[str] = []
    links, in_link, in_article = 0, 0, 0
    at, size = 0, len(page)
    known = None

    def left_out(marks: set[str]) -> bool:
        """Marked elements within a block go at once, by the rule of ``weigh``."""
        nonlocal known
        known = known or extents(page)
        own, holds_article = known[0].get(at, (0, False))
        most = 2 * own > known[1] and (not known[2] or (holds_article and not marks & READERS))
        return not most and bool(marks & FOREIGN or own < LOW_CHARS)

    def flush() -> None:
        nonlocal text, links
        if text:
            block = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if block:
                box.add(block, min(links, len(block)), opened.last("h1", "h2") >= 0)
            text, links = [], 0

    def close(k: int) -> None:
        """Ends the k-th open element and all that are open inside it."""
        nonlocal box, in_link, in_article
        flush()
        while len(opened.tags) > k:
            if item := opened.pop():
                box = item[1]
                in_link -= item[0] == "a"
                in_article -= item[0] in ("article", "main")

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            links += (size - at) * (in_link > 0)
            break
        if m.start() > at:
            text.append(page[at : m.start()])
            links += (m.start() - at) * (in_link > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = opened.last(tag)
            if k >= 0:
                if tag in BLOCKS or tag in CONTAINERS:
                    close(k)
                elif not opened.solid or opened.solid[-1] < k:
                    in_link -= tag == "a"
                    opened.end(k)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if unwanted(tag, m[3], in_article > 0):
            if tag in BLOCKS or tag in CONTAINERS:
                flush()
            at = past(page, at, tag, m[0].endswith("/>"))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            k = opened.last("p")
            if k >= 0 and (not opened.boxes or opened.boxes[-1] < k):
                close(k)
        if tag in ("li", "tr", "td", "th", "dt", "dd"):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            scope = {"tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(tag, ("ul", "ol", "dl"))
            k = opened.last(*same)
            if k > opened.last(*scope):
                close(k)
        marks = marked(tag, m[3], in_article > 0)
        if tag not in BLOCKS and tag not in CONTAINERS:
            if marks and left_out(marks):
                at = past(page, at, tag, m[0].endswith("/>"))
            else:
                opened.push(tag, box)
                in_link += tag == "a"
        else:
            flush()
            opened.push(tag, box)
            in_article += tag in ("article", "main")
            # A marked block is a container of its own, so that it can be taken out.
            if tag in CONTAINERS or marks:
                inner = Box(tag, box, marks)
                box.parts.append(inner)
                boxes.append(inner)
                box = inner
    flush()
    return boxes


def past(page: str, at: int, tag: str, closed: bool) -> int:
    """Where the element that begins before ``at`` ends: after its own end tag, with inner elements of its name counted."""
    if tag in VOID or (closed and tag not in RAW):
        return at
    depth = 1
    while True:
        if tag in RAW:
            m = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            return m.end() if m else len(page)
        m = TAG.search(page, at)
        if m is None:
            return len(page)
        at = m.end()
        inner = (m[2] or "").lower()
        if inner == tag and not m[0].endswith("/>"):
            depth += -1 if m[1] else 1
            if depth == 0:
                return at
        elif inner in ("body", "html") and m[1] and tag != inner:
            return m.start()
        elif inner in RAW and not m[1]:
            at = past(page, at, inner, False)


def blocks(box: Box, menus: bool = False) -> Iterator[str]:
    """The blocks in a container without those that are out and, but with ``menus``, those that are mostly links in a container that is
    mostly links."""
    stack = [(box, iter(box.parts))]
    while stack:
        box, parts = stack[-1]
        for part in parts:
            if isinstance(part, Box):
                if not part.out:
                    stack.append((part, iter(part.parts)))
                    break
            elif menus or not (isinstance(part, Linked) and 2 * box.linked > box.size):
                yield part
        else:
            stack.pop()


def kept_container(best: Box) -> Box:
    """The nearest article or main that holds the best container, or the last one that climbing from it takes."""
    up = best
    while up:
        if up.is_shell:
            return up
        up = up.parent
    kept, up = best, best.parent
    while up:
        if up.raw - kept.raw >= CLIMB * kept.raw:
            kept = up
        up = up.parent
    return kept


def inside(kept: Box) -> list[str]:
    """The text of the kept container, without plain containers of little value at its ends."""
    if kept.is_shell:
        return list(blocks(kept))
    plain = [p for p in kept.parts if isinstance(p, Box) and p.tag in PLAIN and not p.out]
    least = SHARE * max((p.worth for p in plain), default=0.0)
    on_page = kept.parent is None or kept.tag in ("html", "body")

    def stays(part: Box | str) -> bool:
        if not isinstance(part, Box):
            return not isinstance(part, Linked)
        if part.tag not in PLAIN or part.out:
            return not part.out and part.size > 0 and 2 * part.linked <= part.size
        text = "" if on_page or part.linked else next(iter(blocks_backwards(part)), "")
        return (part.worth >= least and part.size > 0) or text.endswith(ENDS)

    worth = [i for i, part in enumerate(kept.parts) if stays(part)]
    if not worth:
        return []
    held = Box(kept.tag, None)
    held.parts, held.size, held.linked = kept.parts[worth[0] : worth[-1] + 1], kept.size, kept.linked
    return list(blocks(held))


def blocks_backwards(box: Box) -> Iterator[str]:
    """The last block of a container, if it has one that is in."""
    stack = [box]
    while stack:
        part = stack.pop()
        if not isinstance(part, Box):
            yield part
            return
        if not part.out:
            stack.extend(part.parts)


def main_text(page: str | None) -> str:
    """The kept container and what stays beside it, joined by line ends; all that is in the tree if that is nothing."""
    boxes = tree(page or "")
    weigh(boxes)
    root = boxes[0]
    if not root.size:
        return ""
    kept = kept_container(max((b for b in boxes if not b.out and b.size), key=lambda b: b.value))
    out: list[str] = []
    around = kept.parent.parts if kept.parent else [kept]
    at = next(i for i, part in enumerate(around) if part is kept)
    for i, part in enumerate(around):
        if i == at:
            out.extend(inside(kept) or blocks(kept, menus=True))
        elif isinstance(part, Box):
            if not part.out and part.size and part.worth >= max(2.0, SHARE * kept.worth) and part.linked < 0.3 * part.size:
                out.extend(blocks(part))
        elif not isinstance(part, Linked) and ((len(part) >= BESIDE_CHARS and points_of(part) >= BESIDE_POINTS) or (i == at - 1 and isinstance(part, Heading))):
            out.append(part)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [main_text(p.as_py()) for p in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def op9_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Each block's white space becomes single spaces and its character references are decoded; blocks are joined in page order by a
    line end.  Null, empty and textless pages give an empty text; every page is read whole.  Repeated rows give repeated results; of containers of
    the same value the first in page order is the best.  No rows give no rows.
    """
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(_extract, StructType([rows.schema["page_id"], rows.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())]))
