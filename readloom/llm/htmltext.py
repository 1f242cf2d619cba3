"""HTML extraction: parser events become lines of text and tags; smoothed text-to-tag ratios select the content."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.common import batches

# Element names and words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody tfoot thead tr ul".split()
)
NOT_CONTENT = frozenset(
    "applet aside audio button canvas datalist dialog embed footer form head iframe input math menu nav noscript object "
    "script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination "
    "popup popover promo promotion recommended related replies reply respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tagcloud toolbar topbar widget widgets".split()
)
#: Those that count inside of a hyphenated name too, and first parts of names that only speak of them.
HINT_PARTS = HINTS - frozenset("banner login modal notification related respond skip widget widgets".split())
ABOUT = frozenset("has is no with without".split())
#: Pages can wrap all they have in such elements, and in ones whose names only contain a hint.
WRAPPERS = frozenset(["form"])
#: Pages can wrap all they have in such elements, and in ones whose names only contain a hint.
WRAPPERS = frozenset(["form"])
#: Elements that are closed when one of these starts inside them.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
#: Width of the Gaussian, in lines, and the share of the deviation that a line must reach.
SIGMA = 1.0
THRESHOLD = 0.5
#: On pages with article or main: factor of the ratios outside of them, and of the threshold inside, which is never above
#: DENSE characters a tag, however long some lines are.
OUTSIDE, INSIDE, DENSE = 0.1, 0.25, 5.0
#: A page whose doubtful elements hold more than so many times the characters of all others is read with them.
DOUBT = 20
#: A page whose doubtful elements hold more than so many times the characters of all others is read with them.
DOUBT = 20
#: So many lines of few characters a tag, one after another, can still be short paragraphs of a region.
SHORT = 2


@dataclass
class Line:
    text: str
    tags: int
    region: int  # the innermost article or main, 0 outside of any; which one it is does not matter


@dataclass
class _Open:
    tag: str
    hidden: bool
    region: int
    doubt: bool = False  # hidden, but only for what a wrapper of the whole page can have too


def _hinted(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether attributes say that an element is no content, and whether only a part of a name does."""
    doubt = False
    for name, value in attrs:
        if name in ("hidden", "inert") or (name == "aria-hidden" and value == "true"):
            return True, False
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True, False
        if name in ("class", "id"):
            words = value.lower().split()
            if not HINTS.isdisjoint(words):
                return True, False
            parts = [p for p in (re.split(r"[-_]+", w) for w in words) if p[0] not in ABOUT]
            doubt = doubt or not HINT_PARTS.isdisjoint(x for p in parts for x in p)
    return doubt, doubt


@dataclass
class LineParser(HTMLParser):
    """Collects the lines of a page; text in elements that are never content is left out, their tags count. Doubtful elements, which are hidden
    unless `lenient`, are WRAPPERS and those whose names only contain a hint; `doubtful` counts their characters."""

    lenient: bool = False
    lines: list[Line] = field(default_factory=list)
    doubtful: int = 0

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._open: list[_Open] = []
        self._count: Counter[str] = Counter()
        self._text: list[str] = []
        self._tags = 0
        self._regions = 0

    def _pop(self) -> _Open:
        top = self._open.pop()
        self._count[top.tag] -= 1
        return top

    def _top(self) -> _Open:
        return self._open[-1] if self._open else _Open("", False, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text or self._tags:
            self.lines.append(Line(text, self._tags, self._top().region))
        self._text, self._tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        top = self._top()
        if tag in VOID:
            self._tags += 1
            if tag == "hr":
                self._end_line()
            elif not top.hidden:
                self._text.append(" ")
            return
        while self._open and tag in CLOSED_BY.get(self._open[-1].tag, ()):
            if self._open[-1].tag in BLOCK:
                self._end_line()
            self._pop()
        if tag == "p":  # inline elements that were left open before a new paragraph do not join the two
            self._end_line()
        if tag in BLOCK:
            self._end_line()
        top = self._top()
        self._tags += 1
        outside = tag == "header" and not top.region
        told, part = False, False
        if tag == "article":
            told, part = _hinted([a for a in attrs if a[0] in ("class", "id", "role")])
        elif tag not in ("html", "body", "main"):
            told, part = _hinted(attrs)
        never = outside or (tag in NOT_CONTENT and tag not in WRAPPERS) or (told and not part)
        doubt = not never and (part or tag in WRAPPERS) and not self.lenient
        if top.hidden:
            doubt = top.doubt and not never
        hidden = top.hidden or never or doubt
        if tag == "main":  # a page's one main part is shown, whatever the names around it
            hidden = doubt = False
        region = top.region
        if tag in ("article", "main") and not hidden:
            self._regions += 1
            region = self._regions
        elif tag == "td" or tag == "th":
            self._text.append(" ")
        self._open.append(_Open(tag, hidden, region, doubt))
        self._count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if not self._count[tag]:  # an end that matches nothing, in constant time
            return
        at = len(self._open) - 1
        while self._open[at].tag != tag:
            at -= 1
        if any(x.tag in BLOCK for x in self._open[at:]):
            self._end_line()
        while len(self._open) > at:
            self._pop()

    def handle_data(self, data: str) -> None:
        top = self._top()
        if not top.hidden:
            self._text.append(data)
        elif top.doubt:
            self.doubtful += sum(map(len, data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def parse_lines(html: str, step: int = 1 << 16) -> list[Line]:
    """The lines of a page; the parser gets the page piece by piece. Where doubtful elements hold nearly all of the text, and no article or main has
    any outside of them, they are taken for wrappers of the page, which is read again with them."""
    for lenient in (False, True):
        parser = LineParser(lenient)
        for i in range(0, len(html), step):
            parser.feed(html[i : i + step])
        lines = parser.finish()
        shown = sum(len(x.text) for x in lines)
        if DOUBT * shown >= parser.doubtful or any(x.region and x.text for x in lines):
            break
    return lines


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat the outermost values."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.concatenate([np.full(radius, ratios[0]), ratios, np.full(radius, ratios[-1])])
    return np.convolve(padded, kernel / kernel.sum(), "valid")


def kept_runs(content: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Lines of text but for runs of more than SHORT lines that are not content, with the lines beside such a run that only
    their neighbours make content."""
    kept = np.ones(len(content), bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], content, [True]])))
    for begin, end in edges.reshape(-1, 2):
        if end - begin <= SHORT:
            continue
        while begin and not dense[begin - 1]:
            begin -= 1
        while end < len(content) and not dense[end]:
            end += 1
        kept[begin:end] = False
    return kept


def content_lines(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[str]:
    """Texts of the selected lines, in page order.

    A line's ratio is its characters per tag. Lines whose smoothed ratio reaches `threshold` standard deviations are
    content. On a page with text in an article or main, that is a prior on the ratios: those of lines outside of all
    such regions are multiplied by OUTSIDE, and the threshold is lowered by INSIDE for lines in any. So a story in several
    regions is whole, and longer runs of lines in a region that are mostly tags are dropped. On other pages lines are taken from
    the first to the last content line, so that short paragraphs between long ones stay.
    """
    if not any(x.text for x in lines):
        return []
    inside = np.array([x.region > 0 for x in lines])
    prior = any(x.region and x.text for x in lines)
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines])
    if prior:
        ratios[~inside] *= OUTSIDE
    smoothed = smooth(ratios, sigma)
    bound = threshold * ratios.std() * np.ones(len(lines))
    if prior:
        bound[inside] = min(INSIDE * bound[0], DENSE)
    content = (smoothed >= bound) & (ratios > 0)
    if not content.any():
        content = ratios > 0
    if prior:
        own = np.flatnonzero(inside & (ratios > 0))
        plain = np.array([x.tags <= 2 for x in lines])  # an element of its own and no more: a paragraph, however short
        content[own] = kept_runs((content | plain)[own], ((ratios >= bound) | plain)[own])
        return [x.text for x, c in zip(lines, content, strict=True) if c]
    at = np.flatnonzero(content)
    return [x.text for x in lines[at[0] : at[-1] + 1] if x.text]


def extract(html: str | None) -> str:
    """Main text of a page: selected lines joined by an empty line; empty for null and for pages without text."""
    return "\n\n".join(content_lines(parse_lines(html or "")))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of `pages`; other columns are left out, repeated rows stay, and so do null ids and urls. Null
    and empty html has an empty text, very long html is parsed piece by piece, lines of equal ratio fare alike, and an empty table gives no rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 200):
            texts = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(x) for x in texts], pa.int64()),
                }
            )

    kind = dict(pages.dtypes)
    schema = f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
