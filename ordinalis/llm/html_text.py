"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page, and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LINE_BREAKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
NESTED = frozenset("""article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table td
    th tr ul""".split())
NEVER = frozenset("""aside audio button canvas datalist dialog footer head iframe menu nav noscript object script select style svg template textarea
    title video""".split())
FURNITURE = frozenset("""ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus
    gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted promotion recommended
    related reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar""".split())
PAGE_FURNITURE = frozenset("footer header topbar".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNSEEN = re.compile(r"display\s*:\s*none")
_LAYOUT = re.compile(r"(?:has|with|no|is|without|layout)[-_]")
#: How firmly an element is furniture: a form that may hold the article, a telling name, an element that never holds it.
FORM, NAMED, HARD = 1, 2, 3


@dataclass
class Frame:
    tag: str
    place: int
    parent: int
    mark: int = 0
    article: int = 0
    main: int = 0


@dataclass
class Line:
    text: str
    ratio: float
    frame: Frame


class PageLines(HTMLParser):
    """Cuts a page into lines at block elements. Each has its text, its text-to-tag ratio and its place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack = [Frame("", 0, -1)]
        self.parents = [-1]
        self.parts: list[str] = []
        self.tags = self.plain = 0
        self.in_link = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            frame = self.stack[-1]
            self.lines.append(Line(text, 0 if frame.mark else self.plain / max(1, self.tags), frame))
            self.tags = 0
        self.parts, self.plain, self.in_link = [], 0, False

    def _names(self, attrs: dict[str, str | None]) -> set[str]:
        names = " ".join(attrs.get(k) or "" for k in ("class", "id")).split()
        return {w.lower() for name in names if not _LAYOUT.match(name) for w in _NAMES.findall(name)}

    def _mark(self, tag: str, attrs: dict[str, str | None], top: Frame) -> int:
        if tag in ("html", "body"):
            return top.mark
        if tag == "main" or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "main":
            return top.mark if top.mark > NAMED else 0
        inside = bool(top.article or top.main)
        if tag in NEVER or "hidden" in attrs or _UNSEEN.search(attrs.get("style") or "") or (tag == "header" and not inside):
            return HARD
        names = self._names(attrs)
        if names & FURNITURE or attrs.get("role") in ROLES or (names & PAGE_FURNITURE and not inside):
            return max(top.mark, NAMED)
        if tag == "form":
            return max(top.mark, FORM)
        if tag == "article" and top.mark == FORM:
            return 0
        return top.mark

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]], closed: bool = False) -> None:
        if tag in LINE_BREAKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        if tag == "body":
            while any(f.tag == "head" for f in self.stack):  # a head without an end
                self.stack.pop()
        if closed and tag in NEVER:
            return
        top, said = self.stack[-1], dict(attrs)
        mark = self._mark(tag, said, top)
        if tag in NESTED or tag in NEVER:
            self.parents.append(top.place)
            place = len(self.parents) - 1
            article = top.article or (place if tag == "article" else 0)
            main = top.main or (place if tag == "main" or said.get("role") == "main" or said.get("itemprop") == "articleBody" else 0)
            if mark != top.mark:
                self.flush()
            self.stack.append(Frame(tag, place, top.place, mark, article, main))
        elif tag == "a":
            self.in_link = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if tag in LINE_BREAKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = False
        elif tag not in ("body", "html") and any(f.tag == tag for f in self.stack):
            if self.stack[-1].mark:
                self.flush()
            while self.stack.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if not self.in_link:
            self.plain += sum(map(len, data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def finish(self) -> list[Line]:
        """What is left is text, unless a tag, a comment or a script was cut off."""
        if not self.cdata_elem and not re.match(r"<[A-Za-z/!?]", self.rawdata):
            self.handle_data(unescape(self.rawdata))
        self.flush()
        return self.lines


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that lie on the page are scaled to one."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[radius:radius + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[radius:radius + len(ratio)]


def threshold(values: np.ndarray) -> float:
    """Two clusters in one dimension: the middle between the means of the values below and above it."""
    t = float(values.mean())
    for _ in range(100):
        low, high = values[values <= t], values[values > t]
        if not len(low) or not len(high):
            return t
        new = (float(low.mean()) + float(high.mean())) / 2
        if new == t:
            break
        t = new
    return t


def main_lines(lines: list[Line], parents: list[int], sigma: float = 1.0) -> list[Line]:
    """Lines of the content regions.

    Lines of the upper cluster of smoothed ratios are seeds. Their region is the article they stand in, else the main
    element, else their own container; directly in the body it is the run of lines around them. A region keeps all its
    lines that are not furniture, however short.
    """
    free = np.array([line.frame.mark == 0 for line in lines])
    if not free.any():
        return []
    ratio = np.where(free, np.maximum([line.ratio for line in lines], 1e-9), 0.0)
    level = np.where(free, smoothed(ratio, sigma), 0.0)
    own = ratio > 1e-9  # text of its own outside links
    seeds = np.flatnonzero(free & (own | ~own.any()) & (level >= min(threshold(level), level[own].max() if own.any() else 0.0)))
    for kind in ("article", "main"):
        chosen = {getattr(lines[i].frame, kind) for i in seeds} - {0}
        if chosen:
            return [line for line, ok in zip(lines, free, strict=True) if ok and getattr(line.frame, kind) in chosen]
    holders = {lines[i].frame.place for i in seeds if lines[i].frame.tag not in ("", "html", "body")}
    keep = np.zeros(len(lines), bool)
    for i, line in enumerate(lines):
        place = line.frame.place
        while place > 0 and place not in holders:
            place = parents[place]
        keep[i] = free[i] and place in holders
    for i in seeds:
        if not keep[i]:
            place = lines[i].frame.place
            for step in (-1, 1):
                j = i
                while 0 <= j < len(lines) and free[j] and lines[j].frame.place == place:
                    keep[j] = True
                    j += step
    return [line for line, ok in zip(lines, keep, strict=True) if ok]


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Main text of one page, a line for each block; empty if there is none."""
    parser = PageLines()
    parser.feed(html or "")
    return "\n".join(line.text for line in main_lines(parser.finish(), parser.parents, sigma))


def _texts(batches: Iterator[pa.RecordBatch], sigma: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(h.as_py(), sigma) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, sigma: float = 1.0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the main text of the whole html, its blocks joined by a line break.

    Parser events cut a page into lines at block elements. A line's ratio is its text outside links to the tags since the
    line before; menus, headers, footers, sidebars, notices, adverts, forms, comments and scripts, told by element, role
    and names, have ratio zero. Ratios are smoothed, two clusters are parted by a threshold, and the regions around the
    upper one are kept with all their lines. Character references are decoded once, white space of a block becomes one
    space, and a line break element is white space.

    Pages are worked one by one where they lie. A null or empty page, and one without text outside furniture, has an empty
    text; a cut-off tag, comment or script at the end is dropped. Equal ratios all belong to one cluster. Null ids and urls
    stay, repeated rows each give a row, an empty table gives an empty one, other columns are not read.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = dict(base.dtypes)
    found = base.mapInArrow(lambda batches: _texts(batches, sigma), f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
