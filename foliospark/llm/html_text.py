"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.common import small_batches

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Elements that hold no main text.
DROPPED = frozenset("aside audio button canvas datalist dialog embed footer form frameset head iframe input label map menu meter nav noscript object option output progress script search select style svg template textarea title video".split())
#: Elements whose content is no text of the page at all.
SILENT = frozenset("audio canvas datalist embed head iframe noscript object script style svg template title video".split())
#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold a page's article.
ARTICLES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of a class or id that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments cookie cookies consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that mark boilerplate outside an article; inside one they may name its own head.
OUTER_MARKS = frozenset(("header", "head", "topbar", "top"))
COMMENTS = frozenset(("comment", "comments", "disqus", "replies", "respond"))

#: Width of the smoothing in lines.
SIGMA = 1.0
#: Lines whose smoothed ratio reaches this share of the ratios' standard deviation are content.
CUT = 0.5
#: Lines below the cut that a cluster closes over.
GAP = 2
#: Share of a page's content from which a kind of block is usual.
KIND = 0.25
_WORDS = re.compile(r"[A-Za-z]+")


@dataclass(slots=True)
class Line:
    """A block of text: its tags, the code points of it that are linked, and the innermost element around it."""

    text: str
    tags: int
    linked: int
    heading: bool
    #: Whether it is in an element that holds no main text; such text weighs nothing.
    outside: bool
    element: int
    #: The tag of the innermost block around it.
    kind: str


@dataclass(slots=True)
class _Open:
    tag: str
    number: int
    dropped: bool
    silent: bool
    article: bool


class Events(HTMLParser):
    """Turns parser events into lines and a tree of elements.

    Elements are numbered as they open, so that those inside an element have the numbers from its own to its ``last``.
    Every event takes constant time, however deep or broken the markup is.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.at: dict[str, list[int]] = {}  # places on the stack by tag
        self.lines: list[Line] = []
        self.parents, self.last = [0], [0]  # by number; 0 is the page
        self.articles: set[int] = set()
        self.open_articles: list[int] = []  # their places on the stack
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.dropped = self.silent = 0
        self.heading = self.paragraph = False

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.heading, self.dropped > 0, self.stack[-1].number if self.stack else 0, "p" if self.paragraph else self.stack[-1].tag if self.stack else ""))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _boilerplate(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in DROPPED:
            return True
        inside = bool(self.open_articles)
        if tag == "header" and not inside:
            return True
        if "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I) or (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true":
            return tag not in ("html", "body")
        if tag in ("html", "body", "main"):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if names == " ":
            return False
        words = {w.lower() for n in _WORDS.findall(names) for w in (n, *re.findall(r"[A-Z]?[a-z]+", n))}
        if tag == "article":
            return bool(words & COMMENTS)
        return bool(words & (MARKS | COMMENTS)) or (not inside and bool(words & OUTER_MARKS))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            self.heading = tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2
            self.paragraph = tag == "p"
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        named = dict(attrs)
        dropped = self._boilerplate(tag, named)
        silent = tag in SILENT or dropped and tag not in BLOCKS  # boilerplate inside a line doesn't part it
        dropped &= not silent
        if tag in BLOCKS and tag != "p" or dropped or silent or tag in ARTICLES:
            number = len(self.parents)
            article = not dropped and not silent and not self.dropped and (tag in ARTICLES or (named.get("role") or "").lower() == "main" or "articlebody" in (named.get("itemprop") or "").lower())
            self.parents.append(self.stack[-1].number if self.stack else 0)
            self.last.append(number)
            self.at.setdefault(tag, []).append(len(self.stack))
            if article:
                self.articles.add(number)
                self.open_articles.append(len(self.stack))
            self.stack.append(_Open(tag, number, dropped, silent, article))
            self.dropped += dropped
            self.silent += silent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self) -> None:
        x = self.stack.pop()
        self.at[x.tag].pop()
        self.last[x.number] = len(self.parents) - 1
        self.dropped -= x.dropped
        self.silent -= x.silent
        if x.article:
            self.open_articles.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        places = self.at.get(tag)
        # A stray end tag doesn't close the article around it.
        found = places and (places[-1] >= (self.open_articles[-1] if self.open_articles else 0) or tag in ("body", "html", "main", "article"))
        if tag in BLOCKS or found and any(self.stack[k].dropped for k in range(places[-1], len(self.stack))):
            self._end_line()
            self.heading = self.paragraph = False
        if tag == "a":
            self.links = max(0, self.links - 1)
        if found:
            while len(self.stack) > places[-1] + 1:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        while self.stack:
            self._close()
        return self.lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, out to three widths."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def content_lines(lines: list[Line], cut: float = CUT) -> np.ndarray:
    """Which lines are content: their smoothed ratio of text outside links to tags reaches the cut.

    Text in elements that hold no main text counts as tags do, not as text; a line of it is never content.
    """
    own = np.array([0 if x.outside else len(x.text) - x.linked for x in lines], float)
    ratio = smoothed(own / np.maximum(1, [x.tags for x in lines]))
    return (ratio >= cut * ratio.std()) & ~np.array([x.outside for x in lines], bool)


def clusters(content: np.ndarray, lines: list[Line], gap: int = GAP) -> list[tuple[int, int]]:
    """Runs of content lines, first and last; up to ``gap`` lines that are not, but could be, part none."""
    out: list[tuple[int, int]] = []
    wall = np.concatenate(([0], np.cumsum([x.outside for x in lines])))
    for k in np.flatnonzero(content).tolist():
        if out and k - out[-1][1] - 1 <= gap and wall[k] == wall[out[-1][1] + 1]:
            out[-1] = out[-1][0], k
        else:
            out.append((k, k))
    return out


def select(lines: list[Line], content: np.ndarray, parents: list[int], last: list[int], articles: set[int]) -> list[Line]:
    """The lines of the main region, given which are content.

    Content lines in blocks of the usual kinds, those that hold a quarter of all content or more, vote, by their length, for the elements around them. The marked article with most votes is the
    region, if it has half of all, else it is the innermost element with nine tenths of them. The clusters that lie in the
    region, at least in part, are taken, if no article bounds them, and so are headings right before them; of what they have beyond the region,
    only headings and lines in blocks of a usual kind (a lead in a paragraph comes, a notice in a bare element doesn't). Of the
    region's other lines, unlinked ones come too (in an unmarked region those between its clusters, those of usual kinds before the first, and those of the last
    one's own element); runs of links and lines in elements without main text don't.
    """
    if not lines or not content.any():
        return []
    weights: dict[str, int] = {}
    for k in np.flatnonzero(content).tolist():
        weights[lines[k].kind] = weights.get(lines[k].kind, 0) + len(lines[k].text) - lines[k].linked
    usual = {kind for kind, n in weights.items() if n >= KIND * sum(weights.values())}
    votes, all_votes = [0] * len(parents), 0
    for x, is_content in zip(lines, content):
        weight = (len(x.text) - x.linked) * bool(is_content)
        votes[x.element] += weight * (x.kind in usual)
        all_votes += weight
    total = sum(votes)
    for n in range(len(parents) - 1, 0, -1):  # numbers grow inwards
        votes[parents[n]] += votes[n]
    found = clusters(content, lines)
    plain = lambda k: content[k] or not lines[k].outside and 2 * lines[k].linked < len(lines[k].text)
    best = max(articles, key=lambda n: (votes[n], n), default=0)  # the inner one, if all content of the outer is in it
    if best and 2 * votes[best] >= all_votes:
        return [x for k, x in enumerate(lines) if best <= x.element <= last[best] and plain(k)]
    region = max(n for n, v in enumerate(votes) if v >= 0.9 * total)
    inside = np.array([region <= x.element <= last[region] for x in lines])
    fits = np.array([x.heading or x.kind in usual for x in lines])
    taken = np.zeros(len(lines), bool)
    for first, end in found:
        if inside[first : end + 1].any():
            taken[first : end + 1] = (inside | fits)[first : end + 1]
    where = np.flatnonzero(taken)
    first, end = int(where[0]), int(where[-1])
    taken[first:end] |= inside[first:end]
    while first and (lines[first - 1].heading and not lines[first - 1].outside or inside[first - 1] and fits[first - 1] and plain(first - 1)):
        first -= 1
        taken[first] = True
    while end + 1 < len(lines) and lines[end + 1].element == lines[end].element and plain(end + 1):
        end += 1
        taken[end] = True
    return [x for k, x in enumerate(lines) if taken[k] and plain(k)]


def main_text(html: str | None, cut: float = CUT) -> str:
    """The main text of a page; empty for a null, an empty page or one without content."""
    if not html:
        return ""
    events = Events()
    events.feed(html)
    lines = events.finish()
    content = content_lines(lines, cut) if lines else np.zeros(0, bool)
    return "\n\n".join(x.text for x in select(lines, content, events.parents, events.last, events.articles))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole of each page in ``out``, which replaces a column of that name.

    A null html, an empty one and one without content have an empty text. Very long pages are read whole, in time that grows with them. Broken markup
    is read as it comes: unclosed elements end with those around them. Repeated rows give equal texts; an empty table gives an empty one; other columns pass through.
    """
    small_batches(pages.sparkSession)
    kept = pages.drop(out) if out != html_col else pages
    names, k = [c for c in kept.columns if c != html_col], kept.columns.index(html_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != html_col), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(h) for h in b.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], names=[*names, out])

    return kept.mapInArrow(run, schema)


def op5(pages: DataFrame) -> DataFrame:
    """Main text of every page and its length in code points."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) AS n_chars")
