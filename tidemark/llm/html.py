"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by role, and names that mark page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td textarea tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside menu head select button textarea".split())
WRAPS = frozenset("form dialog".split())  # furniture, unless the page's article is inside
CONTENT = frozenset("article main".split())
CONTENT_NAMES = frozenset("article articlebody content entry main post story".split())
FRAMES = frozenset("html body main article".split())  # never judged by names
WITH = frozenset("has have no not with without".split())  # a name after these is about something else
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar".split())
WRAP_ROLES = frozenset("form dialog alert".split())
SHORT, LONG = 70, 200  # characters of a block that is judged by itself, and of one that is main text anywhere
STOP_WORDS = frozenset(
    (
        "the of and to a in is that for on with was it as at by from this an be are or not have has "
        "der die und den von zu das mit ist für nicht ein eine als auf im dem des sich auch "
        "de la le et les des en un une que dans qui pour par sur est au du pas il "
        "el y los se del las por con no su para es lo al una"
    ).split()
)

TOKEN = re.compile(
    # A tag that another "<" interrupts outside quotes is none, and what was read is not tried again: a page is read in one pass.
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|canvas|annotation-xml|annotation)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<[!?][^<>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")  # a tag that the page's end cuts
HREF = re.compile(r"\bhref\b", re.I)
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    furniture: bool
    content: bool
    heading: bool


def _is_furniture(tag: str, attrs: str) -> bool:
    """By element, role, or because it is hidden."""
    if tag in FURNITURE:
        return True
    if not attrs:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def _wraps(tag: str, attrs: str) -> bool:
    """A form, a dialog or an alert, by element or role."""
    return tag in WRAPS or bool(attrs) and any(n.lower() == "role" and (a or b or c).lower() in WRAP_ROLES for n, a, b, c in ATTRIBUTE.findall(attrs))


def _named_furniture(tag: str, attrs: str) -> bool:
    """By a part of a class or id."""
    if not attrs or tag in FRAMES:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            for value in (a or b or c).lower().split():
                parts = re.split(r"[_-]+", value)
                if any(x in NAMES and not (k and parts[k - 1] in WITH) for k, x in enumerate(parts)):
                    return True
    return False


def _is_content(tag: str, attrs: str) -> bool:
    if tag in CONTENT:
        return True
    found = ATTRIBUTE.findall(attrs) if attrs and tag in ("div", "section", "td") else []
    return any(n.lower() in ("class", "id") and not CONTENT_NAMES.isdisjoint(re.split(r"[\s_-]+", (a or b or c).lower())) or n.lower() == "role" and (a or b or c).lower() == "main" for n, a, b, c in found)


@dataclass
class Named:
    """An open element that its class or id names as furniture, or that may wrap the page, inside others."""

    outer: "Named | None"
    wraps: bool = False
    bad: bool = True
    within: bool = False  # itself or one around it is bad
    named: bool = False  # the same, of those that don't wrap
    prose: int = 0  # characters of its longer blocks

    def settle(self) -> None:
        self.within = self.bad or self.outer is not None and self.outer.within
        self.named = self.bad and not self.wraps or self.outer is not None and self.outer.named

    def __post_init__(self):
        self.around: Named | None = self if self.wraps else self.outer and self.outer.around  # the nearest that wraps
        self.settle()


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. A tag that is never closed ends with its parent.

    An element that only its class or id names as furniture is none if it holds the
    page's article: its first main element or, without one, its first article. A form or
    dialog is none if it holds that, or the first article inside it, or at least half of the
    page's longer blocks that are no furniture otherwise, as frameworks wrap whole pages in one.
    """
    out: list[Block] = []
    inside: list[Named | None] = []  # of each block, the innermost named element around it
    named_elements: list[Named] = []
    found = {m["tag"].lower() for m in TOKEN.finditer(page) if m["tag"] and m["tag"].lower() in CONTENT}
    wanted = next((x for x in ("main", "article") if x in found), None)
    parts: list[str] = []
    links = link = link_depth = 0
    articles = 0
    stack: list[tuple[str, bool, bool, Named | None]] = []  # open block elements: tag, inside furniture, inside content, named element around
    open_: Counter[str] = Counter()

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            tag, bad, good, named = stack[-1] if stack else ("", False, False, None)
            inside.append(named)
            out.append(Block(text, links, bad, good, tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
        parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        text = html.unescape(piece) if "&" in piece else piece
        parts.append(text)
        if link:
            links += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m["close"])
        if tag == "a":  # it may hold blocks, and ends with the block around it at the latest
            link, link_depth = int(not closing and HREF.search(m["attrs"]) is not None), len(stack)
        elif tag == "br":
            parts.append("\n")
        elif tag in BLOCKS or not closing and (_is_furniture(tag, m["attrs"]) or _wraps(tag, m["attrs"]) or _named_furniture(tag, m["attrs"])) and tag not in VOID or closing and open_[tag]:
            flush()
            if tag in VOID:
                continue
            if closing:
                while open_[tag]:
                    last = stack.pop()[0]
                    open_[last] -= 1
                    if last == tag:
                        break
                if len(stack) < link_depth:
                    link = 0
            else:
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    open_[stack.pop()[0]] -= 1
                bad, good, named = stack[-1][1:] if stack else (False, False, None)
                articles += tag == "article"
                if tag == wanted or tag == "article" and articles == 1 and good:
                    element = named
                    while element is not None:
                        if tag == wanted or element.wraps:
                            element.bad = element.within = False
                        element = element.outer
                    wanted = None if tag == wanted else wanted
                own = tag == "header" and good and not bad and not (named and named.within)  # an article's own heading
                wraps = _wraps(tag, m["attrs"])
                if wraps or not own and _named_furniture(tag, m["attrs"]):
                    named = Named(named, wraps)
                    named_elements.append(named)
                stack.append((tag, bad or not own and _is_furniture(tag, m["attrs"]), good or _is_content(tag, m["attrs"]), named))
                open_[tag] += 1
    if at < len(page):
        add(UNFINISHED.sub("", page[at:]))
    flush()
    for element in named_elements:  # outer elements come first
        element.settle()
    prose = 0
    for block, named in zip(out, inside):
        if len(block.text) >= SHORT and not block.furniture and not (named and named.named):
            prose += len(block.text)
            if named and named.around:
                named.around.prose += len(block.text)
    for element in reversed(named_elements):
        if element.wraps:
            element.bad = element.bad and not 0 < prose <= 2 * element.prose
            if element.outer and element.outer.around:
                element.outer.around.prose += element.prose
    for element in named_elements:
        element.settle()
    for block, named in zip(out, inside):
        block.furniture = block.furniture or named is not None and named.within
    return out


def classify(found: list[Block], short: int = SHORT, long: int = LONG, max_links: float = 0.2, low: float = 0.1, high: float = 0.2) -> list[bool]:
    """Whether each block is main text.

    First pass: furniture and blocks of links are bad; a block of ``short``
    characters is good with many stop words, near-good with some, else bad. Inside an
    article or main element some stop words make it good, and few leave it open, as code or
    a table may be; there a block is one of links only if it and its neighbour mostly
    are, and headings are never judged by links. On a page of which
    few words are known stop words, length alone tells good from near-good. Shorter
    blocks, and long ones between the limits, stay open. Second pass: an open block
    takes the label of its nearest decided neighbours, or of the nearer one if they
    differ (a heading: of the one below); the page's edges count as bad. Inside an
    article or main element it is good unless all its decided neighbours there are bad.
    On a page without any decided block but furniture and links, open blocks are good.
    """

    def stop_words(text: str) -> tuple[int, int]:
        words = WORD.findall(text.lower())
        return sum(w in STOP_WORDS for w in words), len(words)

    def linked(i: int) -> bool:
        b = found[i]
        if not b.content:
            return b.links > max_links * len(b.text)
        near = [x for x in found[max(0, i - 1) : i + 2] if x.content and not x.furniture and not x.heading and 2 * x.links > len(x.text)]
        return not b.heading and b in near and len(near) > 1

    density = [stop_words(b.text) for b in found]
    body = [d for b, d in zip(found, density) if not b.furniture and len(b.text) >= short and b.links <= max_links * len(b.text)]
    foreign = sum(d[0] for d in body) < low * max(1, sum(d[1] for d in body))
    marks: list[bool | None] = []
    for i, (b, (stops, words)) in enumerate(zip(found, density)):
        n, share = len(b.text), high if foreign else stops / max(1, words)
        if b.furniture or linked(i):
            marks.append(False)
        elif n < short:
            marks.append(None)
        elif b.content:
            marks.append(True if share >= low else None)
        else:
            marks.append(True if share >= high and n >= long else (None if share >= low else False))
    undecided = all(m is None or b.furniture or linked(i) for i, (b, m) in enumerate(zip(found, marks)))
    last: list[tuple[int, bool] | None] = []
    seen = None
    for i, m in enumerate(marks):
        # furniture outside the article says nothing about text inside it
        if m is not None and not found[i].furniture:
            seen = (i, m)
        last.append(seen)
    out: list[bool] = []
    seen = None
    for i in range(len(marks) - 1, -1, -1):
        m = marks[i]
        if m is not None and not found[i].furniture:
            seen = (i, m)
        if m is not None:
            out.append(m)
        elif undecided:
            out.append(True)
        elif found[i].content:
            near = [x for x in (last[i], seen) if x and found[x[0]].content]
            out.append(not near or any(x[1] for x in near))
        else:
            before, after = last[i] or (-1, False), seen or (len(marks), False)
            nearer = before if i - before[0] <= after[0] - i and not found[i].heading else after
            out.append(before[1] if before[1] == after[1] else nearer[1])
    return out[::-1]


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, one a line. A null page is empty."""
    found = blocks(page or "")
    return "\n".join(b.text for b, good in zip(found, classify(found)) if good)


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, repeated rows included.

    A null or empty page, or one without main text, gives an empty text. Broken
    markup is read as far as it goes. Other columns are ignored; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", html_column).mapInArrow(run, "page_id long, url string, text string, n_chars long")
