"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block element begins a line, and what stands in a menu,
header, footer, sidebar, notice, advert, form, script, style or comment leaves a blank line.
The length of a line is its text outside links.  Lengths are summed over sliding windows of
lines; the text begins where the sums surge from nothing and ends where they dive to nothing
again.  Between surges and dives lie regions, and the one with the most text is the main text.
Where a page has ``article`` or ``main`` elements with text, the regions inside of them alone
are compared, and the outermost element that holds the best one is the article: all its
lines that were not left out are kept, and with it further such elements unless most of
their text is in links, as that of teasers is.  Elsewhere every region whose highest sum
comes near the best one's is kept too.

Pages are handled where they are read; nothing is shuffled.

Defined cases: null and empty pages, and pages without text, give an empty text; a missing
end tag ends with the element around it; a tag that another ``<`` outside quotes
cuts off is text; an unknown reference stays as it is; pages of any
length are handled whole; repeated rows are repeated in the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, with_fields

WINDOW = 3
"""Lines of a sliding window; blank lines in a row, as many as this, end a region."""
NEAR = 0.5
"""A further region counts if its highest window sum is this share of the main one's."""

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
MARKED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
LEFT_OUT = frozenset("nav header footer aside form button select option datalist menu dialog object applet canvas audio video map label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
# inside these, and inside a line that has begun, an inline element is part of a sentence
SENTENCE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption caption".split())
PHRASE = frozenset("abbr b bdi bdo cite code dfn del em font i ins kbd mark q s samp small strike strong sub sup tt u var".split())
# words of a class or id that tell what the element is for
PURPOSE = re.compile(
    r"ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side-bar|widgets?|toolbar|(?:site|page|top|main|global)[_-]?header|masthead|"
    r"footer|foot|copyright|legal|comments?|commentlist|respond|disqus|replies|reply|discussion|notice|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|"
    r"social|share|sharing|related|recommend\w*|pagination|pager|tags?|skip-link|complementary|contentinfo|search-form|form|header|top", re.I)
# words that may stand beside one of these in a class or id and leave its meaning
BESIDE = re.compile(
    r"\d\w*|area|articles?|bar|block|bottom|box|btn|buttons?|col|column|container|entry|global|group|holder|icons?|inner|items?|left|links?|list|main|meta|outer|page|panel|posts?|primary|right|row|secondary|section|"
    r"side|site|text|title|top|unit|wrap|wrapper|zone|header|", re.I)
READERS = re.compile(r"comments|commentlist|commenters?|discussion|disqus|respond|replies", re.I)
READER = re.compile(r"comment|reply", re.I)
BESIDE_READER = re.compile(r"users?|readers?|threads?|post|posts|reader|body|author|text|meta|form|feed|stream|guest|visitors?", re.I)
AT_ALL = frozenset(("header", "top"))  # a purpose only as a whole class or id
BY_NAME, BY_CLASS = 1, 2
MOST = 0.8
"""An element is never left out for its class or id if it has this share of the text of a page without an article."""


def has_purpose(attributes: str) -> bool:
    """Whether a whole class or id (or the role or label) tells that an element is not text: every word of it fits, as in ``cookie-notice``, not in ``has-sidebar``."""
    for value in MARKED.findall(attributes):
        for token in value.strip("\"' ").split():
            if PURPOSE.fullmatch(token):
                return True
            words = re.split("[_-]+", token)
            # comments of readers: any word that names them, unless it tells what the element merely has
            if words[0].lower() not in ("has", "no", "with") and (any(map(READERS.fullmatch, words)) or any(map(READER.fullmatch, words)) and all(
                    READER.fullmatch(w) or BESIDE_READER.fullmatch(w) or BESIDE.fullmatch(w) for w in words)):
                return True
            told = [bool(PURPOSE.fullmatch(w)) and w.lower() not in AT_ALL for w in words]
            if any(told) and all(t or BESIDE.fullmatch(w) for t, w in zip(told, words)):
                return True
    return False


class Page:
    """The lines of a page: text, length outside links, and the number of the outermost article around (0: none)."""

    def __init__(self):
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.inside = 0
        self.articles = 0
        self.open: Counter[str] = Counter()
        self.doubted: dict[int, tuple[int, int, int | None]] = {}
        """Elements left out for a class or id, by place: their text outside links, that of it in an article, and the outermost such element around."""

    def end_line(self, blank: int = 0) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            self.lines.append((text, max(0, len(text) - self.linked), self.articles if self.inside else 0))
        self.parts, self.linked = [], 0
        self.lines += [("", 0, self.articles if self.inside else 0)] * blank


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """The page without markup.

    A class or id may mislead: where no article with text is left, the element that holds it,
    or that holds most of the page's text, is not left out, nor are those within it that do.
    """
    page = read_page(html, frozenset())
    if not page.doubted or any(t and within for t, _, within in page.lines):
        return page.lines
    rest = sum(length for _, length, _ in page.lines)
    outermost = {k: x for k, x in page.doubted.items() if x[2] is None}
    best = max(outermost, key=lambda k: (outermost[k][1], -k))
    most = outermost[best][1]
    if most and most >= rest:
        kept = {k for k, (_, own, around) in page.doubted.items() if best in (k, around) and own * 2 > most}
    else:
        every = rest + sum(x[0] for x in outermost.values())
        kept = {k for k, (length, _, _) in page.doubted.items() if length >= MOST * every > 0}
    return read_page(html, kept).lines if kept else page.lines


def read_page(html: str, kept: Set[int]) -> Page:
    """The lines of a page; the elements at the places ``kept`` stay whatever their class or id."""
    page, open_, at, n = Page(), [], 0, len(html)
    out_depth = 0  # open elements that are left out
    links = 0
    doubts: list[list[int]] = []  # place, text and article text of open elements left out for a class or id
    paragraphs: list[str] = []  # open paragraphs and articles
    sentences = 0
    firm = mains = 0  # open elements left out for their name, and articles inside what is left out

    def close() -> tuple[str, int]:
        nonlocal out_depth, links, firm, mains, sentences
        last, skipped = open_.pop()
        page.open[last] -= 1
        if last == "p" or last in MAIN:
            paragraphs.pop()
        sentences -= last in SENTENCE
        out_depth -= skipped > 0
        links -= last == "a"
        firm -= skipped == BY_NAME
        mains -= last in MAIN and out_depth > 0
        if skipped == BY_CLASS:
            place, length, own = doubts.pop()
            page.doubted[place] = (length, own, doubts[0][0] if doubts else None)
            if doubts:
                doubts[-1][1] += length
                doubts[-1][2] += own
        return last, skipped

    def in_paragraph() -> bool:
        return bool(paragraphs) and paragraphs[-1] == "p"  # an article ends with its end tag

    while at < n:
        m = TAG.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece and not out_depth:
            page.parts.append(piece)
            if links:
                page.linked += len(piece.strip())
        elif piece and doubts and not firm and not links:
            doubts[-1][1] += len(piece.strip())
            doubts[-1][2] += len(piece.strip()) if mains else 0
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # end tag: closes the elements opened since, if the element is open at all
            if not page.open[name]:
                if name in BLOCKS and not out_depth:
                    page.end_line()
                continue
            while True:
                last, skipped = close()
                if last in BLOCKS and not out_depth and not skipped:
                    page.end_line(WINDOW if last in MAIN and page.inside == 1 else 0)
                if last in MAIN and not skipped and not out_depth:
                    page.inside -= 1
                if last == name:
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            if name not in ("svg", "math"):
                if not out_depth:
                    page.end_line(0 if name in ("script", "style", "template") else 1)
            continue
        if name == "br":
            page.parts.append(" ")
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            if name in BLOCKS and not out_depth:
                page.end_line()
            continue
        if name in BLOCKS:
            # a block ends an open paragraph, and an item the item before
            while open_ and (open_[-1][0] in CLOSED_BY_BLOCK or name == open_[-1][0] == "li") or name not in MAIN and in_paragraph():
                close()
            if not out_depth:
                page.end_line()
        skip = 0
        if name in LEFT_OUT:
            skip = BY_NAME if name != "header" or not (page.inside or mains) else 0  # an article's own header has its title
        elif m[3] and name not in ("html", "body", "article", "main") and m.start() not in kept and has_purpose(m[3]):
            # a part of a sentence is no menu or notice
            worded = name in PHRASE or name not in BLOCKS and (sentences > 0 or any(map(str.strip, page.parts)))
            skip = 0 if worded else BY_NAME if firm else BY_CLASS
        if skip and not out_depth:
            page.end_line(1)
        if name in MAIN and not out_depth:
            page.end_line(0 if page.inside else WINDOW)
            page.articles += not page.inside
            page.inside += 1
        elif name in MAIN:
            mains += 1
        out_depth += skip > 0
        links += name == "a"
        firm += skip == BY_NAME
        if skip == BY_CLASS:
            doubts.append([m.start(), 0, 0])
        open_.append((name, skip))
        page.open[name] += 1
        if name == "p" or name in MAIN:
            paragraphs.append(name)
        sentences += name in SENTENCE
    while open_:
        close()
    page.end_line()
    return page


def regions(lengths: list[int], texts: list[bool], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Surge, dive, sum and highest window sum of each region: lines with text that no whole window of blank lines parts."""
    out = []
    i, n = 0, len(lengths)
    while i < n:
        if not texts[i]:
            i += 1
            continue
        end, gap, j = i, 0, i
        while j < n and gap < window:
            if texts[j]:
                end, gap = j, 0
            else:
                gap += 1
            j += 1
        block = lengths[i : end + 1]
        sums = [sum(block[k : k + window]) for k in range(max(1, len(block) - window + 1))]
        out.append((i, end, sum(block), max(sums)))
        i = end + 1
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by newlines."""
    if not html:
        return ""
    lines = lines_of(html)
    found = regions([length for _, length, _ in lines], [bool(t) for t, _, _ in lines])
    inside = [r for r in found if lines[r[0]][2]]
    if not found:
        return ""
    best = max(inside or found, key=lambda r: (r[2], r[3], -r[0]))
    if inside:
        own, all_ = Counter(), Counter()
        for text, length, k in lines:
            own[k] += length
            all_[k] += len(text)
        kept = {k for k in own if k and own[k] * 2 > all_[k]} | {lines[best[0]][2]}
        return "\n".join(t for t, _, k in lines if t and k in kept)
    keep = [r for r in found if r is best or r[3] >= NEAR * best[3] > 0]
    return "\n".join(t for a, b, _, _ in keep for t, _, _ in lines[a : b + 1] if t)


def extract(pages: DataFrame, column: str = "html", length: str = "n_chars") -> DataFrame:
    """The other columns of ``pages``, ``text`` and its length in code points.  Columns of these names give way."""
    kept = [c for c in pages.columns if c != column and c.lower() not in ("text", length.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, column):
            texts = [main_text(h) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", length])

    return pages.select(*kept, column).mapInArrow(run, with_fields(kept, pages.schema, text="string", **{length: "bigint"}))
