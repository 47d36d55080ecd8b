"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams a page's events; block elements and line breaks begin a new
line.  A line's ratio is its characters of text over its tags.  Ratios are smoothed with a Gaussian
and split in two clusters at the threshold where the two means are equally far; lines of the upper
cluster are content.
"""

from __future__ import annotations

from html.parser import HTMLParser
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import by_batch, need, read

#: Standard deviation of the Gaussian, in lines.
SIGMA = 1.0
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title".split())
#: What stands in them isn't shown; of these, FLAT can't hold blocks.
SILENT = frozenset("script style noscript template svg iframe object textarea select".split())
FLAT = frozenset(("select", "textarea", "title"))


class _Lines(HTMLParser):
    """lines: [[(text, elements around it that are not shown), ...], tags] in order; closed: the
    numbers of those elements whose end was found."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0]]
        self.hidden: list[tuple[int, str]] = []
        self.closed: set[int] = set()
        self.n = 0
        self.title: int | None = None

    def set_cdata_mode(self, elem: str, **more) -> None:
        if elem in self.CDATA_CONTENT_ELEMENTS:  # newer parsers also read titles and text areas so, to the page's end if unclosed
            super().set_cdata_mode(elem, **more)

    def _hide(self, tag: str) -> None:
        self.n += 1
        self.hidden.append((self.n, tag))

    def _close(self, down_to: int) -> None:
        self.closed.update(n for n, _ in self.hidden[down_to:])
        del self.hidden[down_to:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SILENT:
            self._hide(tag)
        elif tag in BLOCK:
            while self.hidden and self.hidden[-1][1] in FLAT:  # they can't hold a block: their end is missing
                self._close(len(self.hidden) - 1)
            self.lines.append([[], 1])
            if tag == "title" and not self.hidden and self.title is None:
                self._hide(tag)
                self.title = self.n
            return
        self.lines[-1][1] += 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in BLOCK:
            self.lines.append([[], 0])
        self.lines[-1][1] += 1

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        open_tags = [t for _, t in self.hidden]
        if tag in open_tags:
            self._close(len(open_tags) - 1 - open_tags[::-1].index(tag))
        if tag in BLOCK:
            self.lines.append([[], 0])

    def handle_data(self, data: str) -> None:
        around = tuple(n for n, _ in self.hidden)
        for i, part in enumerate(data.split("\n")):
            if i:
                self.lines.append([[], 0])
            self.lines[-1][0].append((part, around))

    def shown(self) -> tuple[str, list[list]]:
        """The title, and [text, tags] for each line.  An element whose end isn't there hides nothing,
        or all the rest of the page would be lost, but for scripts and styles."""
        self.closed.update(n for n, t in self.hidden if t in self.CDATA_CONTENT_ELEMENTS)
        title = [t for parts, _ in self.lines for t, around in parts if around == (self.title,) and self.title in self.closed]
        return " ".join(" ".join(title).split()), [["".join(t for t, around in parts if self.closed.isdisjoint(around)), tags] for parts, tags in self.lines]


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over the lines that there are (weights at the ends are scaled up)."""
    if not sigma or not len(ratios):
        return ratios
    reach = int(3 * sigma + 0.5)
    kernel = np.array([exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)])
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Where two clusters part: halfway between the means of what is above and below it; equal values
    are one cluster, above."""
    if float(np.ptp(values)) < 1e-9:  # smoothing leaves rounding errors
        return float(values.min())
    t = float(values.mean())
    while True:
        high = values >= t
        if high.all():
            return t
        after = (float(values[high].mean()) + float(values[~high].mean())) / 2
        if abs(after - t) < 1e-9:
            return after
        t = after


def extract(html: str, sigma: float = SIGMA) -> tuple[str, str, int, int]:
    """(title, content, lines, lines of content)."""
    p = _Lines()
    p.feed(html)
    p.close()
    lines: list[list] = []
    tags = 0
    title, found = p.shown()
    for text, n in found:  # tags of lines without text belong to the next line
        text = " ".join(text.split())
        tags += n
        if text:
            lines.append([text, tags])
            tags = 0
    if not lines:
        return title, "", 0, 0
    smoothed = smooth(np.array([log1p(len(t) / max(1, n)) for t, n in lines]), sigma)
    cut = threshold(smoothed)
    content = [t for (t, _), s in zip(lines, smoothed) if s >= cut]
    return title, "\n".join(content), len(lines), len(content)


def html_content(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """(page_id, title, content, n_lines, n_content) for each row.

    Null html has null title and content and 0 lines; html without text has empty ones; broken
    markup is read as far as the parser makes sense of it (a select or text area ends where a block
    begins; other hidden elements whose end is missing hide nothing, but an unclosed script or style
    is the rest of the page, as in a browser); a page of one kind of line is content as a whole; a null page_id stays null; repeated rows are extracted each; other columns are
    ignored; an empty table gives no rows.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(None, None, 0, 0) if h is None else extract(h, sigma) for h in b.column(1).to_pylist()]
        kinds = (("title", pa.string()), ("content", pa.string()), ("n_lines", pa.int32()), ("n_content", pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds))], ["page_id", *(n for n, _ in kinds)])

    own = need(pages, "page_id", "html").select(F.col("page_id").cast("long"), "html")
    return own.mapInArrow(by_batch(run), "page_id long, title string, content string, n_lines int, n_content int")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """html_content() of all pages."""
    return html_content(read(spark, sf_dir, "pages"))
