"""Main text of web pages by the distribution of line blocks.

A page becomes lines: each block element is a line, markup is stripped, and a line counts as many characters as it has outside of
links. Lines of elements that never hold main text (scripts, navigation, forms, side bars, by their name or by words of their
class, id or role) are blank, and so are lines that are mostly links; where a page says which part is its article, all lines
outside of it are blank. The lines of such an element together are followed by as many blank lines as a window is wide.

The distribution of a page is the sum of characters over WINDOW lines from each line on. Text surges where this sum rises above
the page's threshold, a share of its greatest sum; the surge point is the first line from there on with text of its own, moved back
over text that adjoins it (a headline is short). It dives at the next line from which WINDOW lines are blank. All text between a
surge and its dive is kept, whole, and a page may have several; within an article each line with text belongs to one.

Defined results: null and empty pages, and pages without such text, give an empty text. Character references are decoded, also those
without a semicolon as HTML has them. White space is what Unicode says, and a line break element is white space. What is left open at
the end of a page is closed there; an end tag that opens nothing is left out. Extra columns are ignored, repeated rows are
treated alike, a page's length is bounded by what one row may have, and an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_blocks

#: Lines of a window, the share of the greatest window that is a surge, and the share of links that makes a line blank.
WINDOW, SHARE, LINKS = 3, 0.2, 0.6

#: Elements of HTML. Their text is no text; they hold no main text; they end a line; they have no content.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
APART = RAW | {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "svg", "canvas", "object", "audio", "video", "map"}
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MAIN = {"article", "main"}
#: Words of a class, an id or a role that mark what is no main text.
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar side aside complementary "
    "contentinfo comment comments disqus reply replies respond cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social related "
    "recommended widget toolbar pagination pager copyright disclaimer skip".split()
)
#: Of these, the ones that an article may have which is none of the page's own.
OTHERS = set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended widget".split())
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|[\s"'])hidden(?:[\s=/]|$)|display\s*:\s*none""", re.IGNORECASE)
#: Comments, declarations, tags; an attribute's value may hold a '>'.
_MARKUP = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)


class Line(NamedTuple):
    """A line's text, how many of its characters are outside and inside of links, whether it stands apart, and in an article."""

    text: str
    plain: int
    linked: int
    apart: bool
    inside: bool


def _marked(name: str, attributes: str) -> bool:
    """Whether an element says that it is none of the main text."""
    marks = OTHERS if name in MAIN else MARKS
    if name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for _, value in _ATTRIBUTE.findall(attributes):
        # A word stands alone or between hyphens and underscores, in camel case too.
        words = _WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", value).lower())
        if marks.intersection(words):
            return True
    return False


def lines(page: str) -> Iterator[Line]:
    """The lines of a page, in order."""
    open_elements: list[tuple[str, bool, bool]] = []  # name, stands apart, is an article
    parts: list[str] = []
    counted = [0, 0]
    apart = inside = links = 0
    at = 0

    def ended() -> Iterator[Line]:
        text = " ".join("".join(parts).split())
        if text:
            yield Line(text, counted[0], counted[1], apart > 0, inside > 0)
        parts.clear()
        counted[:] = 0, 0

    def put(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            counted[1 if links else 0] += len(text) - sum(map(len, re.findall(r"\s+", text)))

    def close(k: int) -> None:
        nonlocal apart, inside, links
        while len(open_elements) > k:
            name, is_apart, is_main = open_elements.pop()
            apart, inside, links = apart - is_apart, inside - is_main, links - (name == "a")

    while True:
        tag = _MARKUP.search(page, at)
        put(page[at : tag.start()] if tag else page[at:])
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            yield from ended()
        if name == "br":
            parts.append(" ")
        elif closing:
            # An end tag ends the nearest element of its name, unless a block that is still open stands between and it is inline.
            for k in range(len(open_elements) - 1, -1, -1):
                if open_elements[k][0] == name:
                    close(k)
                    break
                if name not in BLOCKS and open_elements[k][0] in BLOCKS:
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if name in BLOCKS:  # a block ends a paragraph that is open, and a list's item the one before
                _implied(open_elements, name, close)
            open_elements.append((name, name in APART or _marked(name, attributes), name in MAIN))
            apart, inside, links = apart + open_elements[-1][1], inside + open_elements[-1][2], links + (name == "a")
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                close(len(open_elements) - 1)
                at = end.end() if end else len(page)
    yield from ended()


#: Elements that end when one of these begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
_SCOPES = {"ul", "ol", "menu", "table", "dl"}


def _implied(open_elements: list, name: str, close) -> None:
    ends = _ENDS.get(name, set()) | {"p"}
    for k in range(len(open_elements) - 1, -1, -1):
        other = open_elements[k][0]
        if other in ends:
            close(k)
            if other != "p":
                return
        elif other in _SCOPES or other in BLOCKS and other != "p" and name not in _ENDS:
            return


def _runs(weight: np.ndarray, window: int, share: float) -> list[tuple[int, int]]:
    """Lines from a surge to its dive, for each."""
    padded = np.concatenate([weight, np.zeros(window, dtype=np.int64)])
    total = np.concatenate([[0], np.cumsum(padded)])
    sums = total[window:] - total[:-window]  # from each line on
    surging = np.flatnonzero(sums[: len(weight)] > share * sums.max(initial=0))
    out, at = [], 0
    for start in surging.tolist():
        if start < at:
            continue
        first = start + int(np.flatnonzero(padded[start : start + window])[0])
        while first > at and padded[max(at, first - window) : first].any():
            first = max(at, first - window) + int(np.flatnonzero(padded[max(at, first - window) : first])[0])
        dive = np.flatnonzero(sums[first:] == 0)
        at = first + int(dive[0]) if len(dive) else len(weight)
        out.append((first, at))
    return out


def main_text(page: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    """The blocks of a page's main text, joined by blank lines."""
    found = list(lines(page or ""))
    article = any(x.inside and not x.apart for x in found)
    kept: list[Line | None] = []
    for x in found:
        if x.apart or article and not x.inside:
            # Within the article what stands apart is no gap.
            if not x.inside and (not kept or kept[-1] is not None):
                kept += [None] * window
        else:
            kept.append(x)
    weight = np.array([0 if x is None else max(1, x.plain) if article or x.linked <= LINKS * (x.plain + x.linked) else 0 for x in kept], dtype=np.int64)
    # An article's own lines all belong to it, however short.
    spans = _runs(weight, window, 0.0 if article else share)
    return "\n\n".join(kept[k].text for a, b in spans for k in range(a, b) if kept[k] is not None and weight[k])


def extracted(pages: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            for part in text_blocks([batch]):
                texts = [main_text(p, window, share) for p in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", pages["html"].alias("text")).mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string, n_chars long")
