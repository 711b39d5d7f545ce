"""Main-text extraction by text-to-tag ratio.

``html.parser`` streams the events of a page. Block tags break its text into lines; a line's ratio is its characters
over the tags inside it, and counts ``BOOST`` times inside an article or main element. Ratios are smoothed by a Gaussian
over neighbouring lines of one group, and lines are clustered by a threshold, a share of the smoothed
ratios' deviation and mean: lines above it are content. Around them regions grow: lines below the threshold are kept
where they stand in one group with content, between lines of it, or next to them as blocks of their own that are not
all links. A group is an article or main element with what is in it, or else the children of one container, cut where a
part begins or ends that is no article.
Lines in parts that by their tag or their class and id are no article (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) and scripts, styles and comments are never content.

A class or id says less than a tag: main elements, and article elements that are no comments or teasers, stand out
of a part that only its class or id marks, and if nothing else is left, what only a class or id marks is content.
So is then an article element in a header, which was left open. Headings in an article's own header are its headline.

Defined results: null, empty and malformed pages give the text found, or an empty string; an unclosed tag
ends with the block around it; only the columns named in ``keep`` are carried, but for one named ``text``; rows are
treated one by one, so repeated ones alike; an empty table gives no rows; a page of any length and depth is one task's
row, in time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried

SIGMA = 1.0
#: Share of mean plus deviation that a smoothed ratio must reach.
SHARE = 0.3
#: How many times the ratio of a line counts in an article or main element.
BOOST = 8.0

#: Elements by how they are treated.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg object iframe canvas textarea select".split())
ASIDE = frozenset("nav header footer aside form menu dialog button".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|related|recommend\w*|share|sharing|social|"
    r"comments?|comment-\w+|replies|disqus|cookies?|consent|notice|popup|modal|overlay|subscribe|newsletter|signup|login|form|search|tags|pagination|pager|copyright|legal)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Names of a layout, not of a part: has-sidebar, no-menu.
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|have|with|without|no)[_-]\S+", re.IGNORECASE)
#: Parts whose article elements are reader comments or teasers of other pages.
OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-\w+|replies|disqus|related|recommend\w*|ads?|advert\w*|sponsor\w*|promo\w*|widget)(?:$|[\s_-])", re.IGNORECASE)
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Blocks that hold others as their children; the rest are lines of the container they stand in.
CONTAINER = frozenset("html body article main section div center aside header footer nav form fieldset dialog menu".split())
#: Blocks that lists of links are made of.
LISTS = frozenset("ul ol dl table span".split())
SPACE = re.compile(r"\s+")
#: How much an element is set aside: by its class or id, as a header, by the class or id of comments or teasers, by its tag.
NAME_ASIDE, HEADER_ASIDE, OTHERS_ASIDE, TAG_ASIDE = 1, 2, 3, 4
#: What is looked at, in this order, until something is left.
TAKEN = ((0,), (0, NAME_ASIDE), (0, NAME_ASIDE, OTHERS_ASIDE))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A name that a list has, and not a paragraph.
LINK_LIST = re.compile(r"(?<![^\s_-])tags(?![^\s_-])", re.IGNORECASE)


@dataclass
class Line:
    text: str
    tags: int
    aside: int  # 0: not set aside
    region: int  # 0: outside any article or main element
    part: int
    box: int  # the container that the line's block is a child of
    block: bool  # in a block of its own, not directly in a container
    linked: bool  # all of it is links


@dataclass
class Open:
    """An open element and what holds inside it."""

    tag: str = ""
    hidden: bool = False
    aside: int = 0
    region: int = 0
    box: tuple[int, int, bool] = (0, 0, True)
    link: bool = False
    block: int = -1  # place of the nearest open block, this element included


OUTSIDE = Open()


class Lines(HTMLParser):
    """Lines of text with the tags inside them, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.lines: list[Line] = []
        self.buffer: list[str] = []
        self.tags = self.regions = self.part = self.boxes = 0
        self.linked = True

    def inner(self) -> Open:
        return self.stack[-1] if self.stack else OUTSIDE

    def push(self, own: Open) -> None:
        if own.tag in BLOCK:
            own.block = len(self.stack)
        self.places.setdefault(own.tag, []).append(len(self.stack))
        self.stack.append(own)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        if text:
            at = self.inner()
            box, outer, block = at.box
            self.lines.append(Line(text, self.tags, at.aside, at.region, self.part, box if block else outer, block, self.linked))
        self.buffer, self.tags, self.linked = [], 0, True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body" or self.inner().tag == "head" and tag not in IN_HEAD:  # the end tag of a head may be left out
            self.pop_to("head")
        at = self.inner()
        if at.hidden:  # inside hidden text only its end counts
            if tag not in VOID and (tag in IN_HEAD and at.tag == "head" or tag == at.tag):
                self.push(replace(at, tag=tag))
            return
        if tag in BLOCK:
            self.flush()
            while tag in CLOSED_BY.get(self.block(), ()):
                self.pop_to(self.block())
        else:
            self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        at, own = self.inner(), dict(attrs)
        aside, region, box = at.aside, at.region, at.box
        names = f"{own.get('class') or ''} {own.get('id') or ''} {own.get('role') or ''}"
        if tag in ("article", "main") and not region:
            self.regions += 1
            region = self.regions
            if aside == NAME_ASIDE or aside == OTHERS_ASIDE and tag == "main":
                aside = 0
                self.part += 1
            elif aside == HEADER_ASIDE:
                aside = NAME_ASIDE
                self.part += 1
        if tag in HEADINGS and region and aside == HEADER_ASIDE:
            aside = 0
            self.part += 1
        if tag == "header" and "hidden" not in own:
            mark = HEADER_ASIDE
        elif tag in ASIDE or "hidden" in own:
            mark = TAG_ASIDE
        elif tag not in ("html", "body", "article", "main") and NAMED.search(names := LAYOUT.sub("", names if tag in CONTAINER or tag in LISTS else LINK_LIST.sub("", names))):
            mark = OTHERS_ASIDE if OTHERS.search(names) else NAME_ASIDE
        else:
            mark = 0
        if mark:
            aside = max(aside, mark)
            self.part += 1
        if tag in CONTAINER:
            self.boxes += 1
            box = (self.boxes, box[0], False)
        elif tag in BLOCK:
            box = (box[0], box[1], True)
        self.push(Open(tag, at.hidden or tag in HIDDEN, aside, region, box, at.link or tag == "a", at.block))

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        else:
            self.tags += 1
        if places := self.places.get(tag):
            if tag in BLOCK or places[-1] > self.stack[-1].block:  # an inline tag ends nothing outside its block
                self.pop_to(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        blank = not data.strip()
        if not blank and self.inner().tag == "head":
            self.pop_to("head")
        at = self.inner()
        if not at.hidden:
            self.buffer.append(data)
            self.linked = self.linked and (at.link or blank)

    def block(self) -> str:
        return self.stack[self.stack[-1].block].tag if self.stack and self.stack[-1].block >= 0 else ""

    def pop_to(self, tag: str) -> None:
        """Ends the last open element of this tag, if there is one, and all in it."""
        if not (places := self.places.get(tag)):
            return
        to, aside = places[-1], 0
        while len(self.stack) > to:
            gone = self.stack.pop()
            self.places[gone.tag].pop()
            aside = aside or gone.aside
        if aside:
            self.part += 1


def lines_of(html: str | None) -> list[Line]:
    own = Lines()
    own.feed(html or "")
    own.close()
    own.flush()
    return own.lines


def groups_of(lines: list[Line]) -> list[tuple[int, int]]:
    return [(x.region, 0 if x.region else x.box) for x in lines]


def smooth(ratios: list[float], groups: list, sigma: float) -> list[float]:
    """Gaussian mean of each line's neighbours in its own group."""
    import numpy as np

    numbers: dict = {}
    x, part = np.array(ratios), np.array([numbers.setdefault(g, len(numbers)) for g in groups])
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for d in range(-int(3 * sigma), int(3 * sigma) + 1):
        w = float(np.exp(-(d**2) / (2 * sigma**2)))
        a, b = max(0, d), min(len(x), len(x) + d)
        if a < b:
            same = part[a:b] == part[a - d : b - d]
            total[a - d : b - d] += np.where(same, w * x[a:b], 0)
            weight[a - d : b - d] += np.where(same, w, 0)
    return (total / np.maximum(weight, 1e-12)).tolist()


def grow(lines: list[Line], found: list[bool]) -> list[bool]:
    """``found``, and the lines between found ones of one group, and next to them if they are blocks of their own and not all links."""
    groups: dict[tuple[int, int], list[int]] = {}
    for i, group in enumerate(groups_of(lines)):
        groups.setdefault(group, []).append(i)
    out = list(found)
    for own in groups.values():
        hits = [k for k, i in enumerate(own) if found[i]]
        if not hits:
            continue
        first, last = hits[0], hits[-1]
        joins = lambda k: lines[own[k]].block and not lines[own[k]].linked
        while first > 0 and joins(first - 1):
            first -= 1
        while last < len(own) - 1 and joins(last + 1):
            last += 1
        for i in own[first : last + 1]:
            out[i] = True
    return out


def cluster(lines: list[Line], sigma: float = SIGMA, share: float = SHARE) -> list[bool]:
    """Whether each line's smoothed ratio lies above the threshold."""
    ratios = [len(x.text) / (1 + x.tags) * (BOOST if x.region else 1) for x in lines]
    smoothed = smooth(ratios, [(x.part, *g) for x, g in zip(lines, groups_of(lines), strict=True)], sigma)
    mean = sum(smoothed) / len(smoothed)
    deviation = (sum((x - mean) ** 2 for x in smoothed) / len(smoothed)) ** 0.5
    return [x >= share * (mean + deviation) / 2 for x in smoothed]


def extract(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The main text of one page."""
    every = lines_of(html)
    lines = next((own for taken in TAKEN if (own := [x for x in every if x.aside in taken])), [])
    if not lines:
        return ""
    return " ".join(x.text for x, f in zip(lines, grow(lines, cluster(lines, sigma, share)), strict=True) if f)


def main_text(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (page_id and url if not given) and ``text`` for every page."""
    keep = carried(keep or ["page_id", "url"], ["text", "html_"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column("html_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    kept = pages.select(*[F.col(f"`{c}`") for c in keep], F.col("html").alias("html_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html_")
    return kept.mapInArrow(run, f"{schema}, text string")
