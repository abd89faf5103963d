"""Main text of web pages by minimum cut.

A page is a row of text blocks. What a classifier finds for and against a block
becomes its capacity to the source (content) and to the sink (boilerplate);
blocks next to each other, and blocks in one parent, are tied by smoothness
edges that weaken with their distance in the document tree. The maximum flow
gives the cheapest labelling, and the content side is the article.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# elements whose text is not shown; a comment, a declaration, or a tag
_MARKUP = re.compile(
    r"<(?:(?P<raw>script|style|noscript|template|textarea|title|iframe)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|!--.*?(?:-->|\Z)|[!?][^>]*>"
    r"|(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attributes>[^>]*)>)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
# an opening tag ends an open element of these names that is innermost
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
AGAINST_TAGS = frozenset("nav footer aside button menu search select".split())
# those that may just as well hold the page
HOLDER_TAGS = frozenset("form dialog fieldset".split())
AGAINST_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager "
    "pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split()
)
# words that name parts of an article as well
DOUBTFUL_WORDS = frozenset("alert disclaimer feedback header legal notice notification overlay popular search survey warning".split())
# what follows them in a class name is about the page, not about the element
_QUALIFIERS = frozenset("no not without with has have hide show".split())
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
FOR_WORDS = frozenset("article body content entry main post story text".split())
# what speaks for and against a block, as log odds
SECTION_AGAINST, WORDS_AGAINST, DOUBTFUL, SECTION_FOR, WORDS_FOR = -6.0, -6.0, -3.0, 2.5, 1.5
LINKS, LONG, VERY_LONG, SENTENCE, ITEM, START = -4.0, 1.5, 2.0, 0.7, -0.5, -1.0
# what is left, one level further down, of what words speak against an element
FADE = 0.85
# nothing outweighs that a block is not shown
HIDDEN = -1000.0
# words from which a block is long, and very long
LONG_WORDS, VERY_LONG_WORDS = 30, 120
# smoothness between blocks of one parent; halved with every step that the tree sets them further apart
TIE = 0.8


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    score: float  # of the element and what it is in
    words: float  # what names speak against it; fades
    inside: bool  # an article or main element
    hidden: bool
    last: int = -1  # its latest block


@dataclass
class Block:
    text: str
    element: Element
    links: float  # share of its characters in links


def _words(value: str) -> set[str]:
    """Words of class names or an id; a name counts up to a word such as no, with or has."""
    words: set[str] = set()
    for name in value.split():
        parts = [w.lower() for w in _NAME_PARTS.findall(name)]
        words |= set(itertools.takewhile(lambda w: w not in _QUALIFIERS, parts))
    return words


def _element(name: str, attributes: str, parent: Element) -> Element:
    inside, hidden = parent.inside or name in ("article", "main"), parent.hidden
    against = name in AGAINST_TAGS or (name == "header" and not inside)
    score = SECTION_FOR if name in ("article", "main") else 0.0
    cost = DOUBTFUL if name in HOLDER_TAGS else 0.0
    words: set[str] = set()
    for key, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"' ")
        if key in ("class", "id"):
            words |= _words(value)
        elif key == "role":
            against |= value.lower() in AGAINST_ROLES
            inside |= value.lower() in ("main", "article")
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
        elif key == "aria-hidden":
            against |= value.lower() == "true"
    if name not in ("html", "body"):
        if words & AGAINST_WORDS:
            cost = WORDS_AGAINST
        elif words & DOUBTFUL_WORDS and name not in ("article", "main"):
            cost = DOUBTFUL
        if words & FOR_WORDS:
            score += WORDS_FOR
    score += SECTION_AGAINST if against else 0.0
    return Element(name, parent, parent.depth + 1, score + parent.score, cost + FADE * parent.words, inside, hidden)


def _tags(page: str) -> Iterator[tuple[int, re.Match, str, int]]:
    """Markup from first to last in one pass: where it starts, its match, its attributes and where it ends.

    A tag ends at the first > outside quotes; a quote that is never closed is none.
    """
    limit, at = page.rfind(">") + 1, 0
    closable = {'"': True, "'": True}
    while (tag := _MARKUP.search(page, at, limit)) is not None:
        attributes, at = tag["attributes"] or "", tag.end()
        quote = re.match(r"(?:[^\"']|\"[^\"]*\"|'[^']*')*+([\"'])", attributes)
        if quote and closable[quote[1]]:
            close = page.find(quote[1], at)
            end = page.find(">", close) if close >= 0 else -1
            closable[quote[1]] = close >= 0
            if end >= 0:
                attributes, at = attributes + page[at - 1 : end], end + 1
        yield tag.start(), tag, attributes, at


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page, in page order; inline markup joins, block elements part."""
    top = here = Element("", None, 0, 0.0, 0.0, False, False)
    found: list[Block] = []
    parts: list[str] = []
    linked, link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, here, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    for start, tag, attributes, end in _tags(page):
        if start > at:
            piece = page[at:start]
            parts.append(piece)
            linked += len(piece.strip()) if link else 0
        at = end
        name = (tag["name"] or "").lower()
        if name == "a":
            link = not tag["end"]
        elif name == "br":
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            link = False
            if tag["end"]:
                other = here
                while other is not top and other.name != name:
                    other = other.parent
                if other is not top:
                    here = other.parent
            elif name not in VOID:
                while here is not top and here.name in _ENDS.get(name, {"p"}):
                    here = here.parent
                here = _element(name, attributes, here)
    parts.append(page[at:])
    flush()
    return found


def odds(block: Block) -> float:
    """The classifier: log odds that a block is content."""
    element, words = block.element, block.text.count(" ") + 1
    score = START + element.score + element.words + LINKS * block.links + LONG * min(words, LONG_WORDS) / LONG_WORDS
    score += VERY_LONG * min(max(words - LONG_WORDS, 0) / (VERY_LONG_WORDS - LONG_WORDS), 1.0)
    if block.text[-1] in ".!?…\"”»:;":
        score += SENTENCE
    if element.name == "li":
        score += ITEM
    elif element.name in ("p", "pre", "blockquote", "h1", "h2", "h3"):
        score -= ITEM
    return HIDDEN if element.hidden else score


def _apart(a: Element, b: Element) -> int:
    """Steps in the tree from the parents of two elements to where they meet."""
    a, b, steps = a.parent or a, b.parent or b, 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
        if steps > 8:
            break
    return steps


def ties_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in the page, and neighbours among the blocks of one parent.

    None joins a block that is not shown to another.
    """
    ties = []
    for i, block in enumerate(blocks):
        if block.element.hidden:
            continue
        parent = block.element.parent or block.element
        if i and not blocks[i - 1].element.hidden:
            ties.append((i - 1, i, TIE / 2 ** _apart(blocks[i - 1].element, block.element)))
        if 0 <= parent.last < i - 1:
            ties.append((parent.last, i, TIE))
        parent.last = i
    return ties


def cheapest_labels(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: content or not for each block, at the least sum of overruled scores and cut ties.

    Flow is pushed along shortest paths from blocks for which more speaks than
    against to the others; what still can be reached from the former is content.
    """
    left = [abs(s) for s in scores]
    edges: list[dict[int, float]] = [{} for _ in scores]
    for a, b, weight in ties:
        edges[a][b] = edges[a].get(b, 0.0) + weight
        edges[b][a] = edges[b].get(a, 0.0) + weight
    tiny = 1e-9
    while True:
        before = {i: -1 for i, s in enumerate(scores) if s > 0 and left[i] > tiny}
        queue, end = deque(before), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, room in edges[i].items():
                if room > tiny and j not in before:
                    before[j] = i
                    if scores[j] <= 0 and left[j] > tiny:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in before or (s > 0 and left[i] > tiny) for i, s in enumerate(scores)]
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        flow = min(left[path[0]], left[path[-1]], *[edges[a][b] for b, a in zip(path, path[1:])])
        left[path[0]] -= flow
        left[path[-1]] -= flow
        for b, a in zip(path, path[1:]):
            edges[a][b] -= flow
            edges[b][a] += flow


def label_page(page: str) -> list[tuple[Block, bool]]:
    blocks = blocks_of(page)
    return list(zip(blocks, cheapest_labels([odds(b) for b in blocks], ties_of(blocks))))


def label_blocks(pages: DataFrame) -> DataFrame:
    """Every block of every page (page_id, html): page_id, block, tag, text and whether it is content."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = label_page(source or "")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([page] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([b.element.name for b, _ in rows], pa.string()),
                        pa.array([b.text for b, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.bool_()),
                    ],
                    ["page_id", "block", "tag", "text", "content"],
                )

    return pages.select("page_id", "html").mapInArrow(label, "page_id long, block int, tag string, text string, content boolean")


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html), from the whole page.

    Character references are decoded, white space inside a block becomes one
    space, and content blocks are joined in page order by one space. A null or
    empty page, or one without content, gives ''. ``n_chars`` counts code points;
    ``n_blocks`` counts all blocks. Repeated rows are extracted each, other
    columns are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labelled = [label_page(source or "") for source in batch.column(2).to_pylist()]
            texts = [" ".join(b.text for b, content in rows if content) for rows in labelled]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array([len(r) for r in labelled], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks long")
