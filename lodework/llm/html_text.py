"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a block of text is a line.  What the page marks as something else than its article
(navigation, page header and footer, asides, forms, adverts, notices, comments, by element or by class, id and role)
leaves ``BLOCK`` blank lines, and so does the border of an article; other sections follow each other without.  The text
lengths over windows of ``BLOCK`` lines form the distribution, in which a line of an article counts ``WEIGHT`` times.
It surges where a window with text follows blank ones, and dives where it returns to zero; a stretch between the two is
kept if some window in it exceeds ``SURGE`` characters that are not links, or is the page's fullest.  Of a kept stretch
with sections that exceed it alone, those before the first and after the last of these are left off if they have neither
a heading or paragraph nor the end of a sentence; sections that are mostly links go, unless all are.  Every other line of
a kept stretch is kept.  A class or id marks an element only as a whole: of the words that hyphens join, those that
tell place or shape are passed over and all others must be marks, so ``site-footer`` is one, ``has-sidebar`` is not.

Defined results: null html is the empty page; a page without text gives the empty text; an element that is never
closed ends where its parent does, a paragraph before the next block, markup that is no element is text; equal rows give equal rows; pages are read whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import blocks

BLOCK, SURGE, WEIGHT = 3, 86, 8

# Elements by what they mean for the text.
UNSEEN = frozenset("script style noscript template head iframe object svg math canvas audio video select textarea button datalist map".split())
OTHER = frozenset("nav aside form footer menu dialog".split())
SECTIONS = frozenset("html body article section main div header table hgroup".split())
BREAKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption br hr tr td th caption thead tbody tfoot address details summary fieldset legend".split()) | SECTIONS | OTHER
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that mark something else than the article, and such roles.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
                  "sidebar aside footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay "
                  "comment comments respond replies disqus share sharing social related recommended newsletter subscribe signup login search "
                  "pagination pager widget toolbar skip".split())
#: Words beside a mark in a class or id that tell its place or shape.
NEUTRAL = frozenset("site page main global top bottom left right primary secondary box list links buttons bar block wrapper wrap container inner "
                    "area section posts items item group panel form content text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
ARTICLE = frozenset("article main".split())
BORDERED = ARTICLE | OTHER
#: Elements of running text, and what a sentence ends in.
RUNNING = tuple("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ENDS = tuple(".!?\u2026\u3002\uff01\uff1f")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
                   r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z0-9]+")


def is_mark(value: str) -> bool:
    """Whether one class or id, as a whole, names something else than the article."""
    words = [w for w in PARTS.findall(value) if w not in NEUTRAL and not w.isdigit()]
    return bool(words) and MARKS.issuperset(words)


def marked(rest: str) -> bool:
    """Whether attributes say that an element is not part of the article."""
    for name, value in NAMED.findall(rest):
        value = value.strip("\"'").lower()
        if name.lower() == "role":
            if value in ROLES:
                return True
        elif any(map(is_mark, value.split())):
            return True
    return False


class Page:
    """The lines of one page: (text, characters outside links, within the article, number of its section, running text)."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, bool, int, bool]] = []
        self.section = 0
        self.parts: list[str] = []
        self.free = 0
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: name, within the article, left out
        self.open: Counter[str] = Counter()  # how many of each name are open
        self.breaks: list[int] = []  # depths of those that break lines
        self.read(html)

    def close_line(self, blank: int = 0) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            running = any(map(self.open.__getitem__, RUNNING)) or text.endswith(ENDS)
            self.lines.append((text, self.free, bool(self.stack) and self.stack[-1][1], self.section, running))
        self.parts, self.free = [], 0
        if blank and self.lines and self.lines[-1][0]:
            self.lines.extend([("", 0, False, self.section, False)] * blank)

    def cut(self, depth: int) -> None:
        """Close the open elements from a depth on."""
        for name, _, _ in self.stack[depth:]:
            self.open[name] -= 1
        del self.stack[depth:]
        while self.breaks and self.breaks[-1] >= depth:
            self.breaks.pop()

    def read(self, html: str) -> None:
        at = 0
        tokens = list(TOKEN.finditer(html))
        outer = self.with_article(tokens)
        for k, token in enumerate(tokens):
            out = bool(self.stack) and self.stack[-1][2]
            if not out and token.start() > at:
                text = unescape(html[at : token.start()])
                self.parts.append(text)
                if not self.open["a"]:
                    self.free += len(text.strip())
            at = token.end()
            name = (token["name"] or "").lower()
            if not name:
                continue
            inside = bool(self.stack) and self.stack[-1][1]
            border = BLOCK if name in BORDERED and not inside else 0
            if not out and name in BREAKS:
                self.close_line(border)
                self.section += name in SECTIONS and not inside
            if not token["end"]:
                if name in VOID or token["rest"].endswith("/"):
                    continue
                self.imply_end(name)
                inside, out = (self.stack[-1][1:] if self.stack else (False, False))
                article = name in ARTICLE or inside
                left_out = out or name in UNSEEN or (k not in outer and (
                    name in OTHER or name == "header" and not inside or name not in ("html", "body", "article", "main") and self.elsewhere(token["rest"], inside)))
                if left_out and not out:
                    self.close_line(0 if inside else BLOCK)
                if name in BREAKS:
                    self.breaks.append(len(self.stack))
                self.stack.append((name, article, left_out))
                self.open[name] += 1
            elif self.open[name]:
                depth = len(self.stack) - 1
                while self.stack[depth][0] != name:
                    depth -= 1
                self.cut(depth)
                if inside and not out and not (self.stack and self.stack[-1][1]):
                    self.close_line(BLOCK)
        if not (self.stack and self.stack[-1][2]) and at < len(html):
            self.parts.append(unescape(html[at:]))
            self.free += len(html) - at
        self.close_line()

    def imply_end(self, name: str) -> None:
        """A paragraph ends before the next block, an item before the next item, unless a section stands between."""
        ended = "p" if name in BREAKS and name != "li" else name if name in ("li", "dt", "dd", "tr", "td", "th") else ""
        if self.breaks and self.stack[self.breaks[-1]][0] == ended:
            self.cut(self.breaks[-1])

    @staticmethod
    def elsewhere(rest: str, inside: bool) -> bool:
        # within an article, a header is its own
        return marked(re.sub(r"(?i)header|masthead|banner", "", rest) if inside else rest)

    @staticmethod
    def with_article(tokens: list) -> set[int]:
        """Numbers of the opening tokens of elements around an article: these are never left out."""
        stack: list[tuple[str, int]] = []
        held: Counter[str] = Counter()
        around: set[int] = set()
        for k, token in enumerate(tokens):
            name = (token["name"] or "").lower()
            if not name or name in VOID or token["rest"].endswith("/"):
                continue
            if not token["end"]:
                if name in ARTICLE:
                    # who stands around one that stands around this one is known
                    for _, n in reversed(stack):
                        if n in around:
                            break
                        around.add(n)
                stack.append((name, k))
                held[name] += 1
            elif held[name]:
                closed = None
                while closed != name:
                    closed = stack.pop()[0]
                    held[closed] -= 1
        return around


def main_text(html: str) -> str:
    lines = Page(html).lines
    if not lines:
        return ""
    lengths = np.array([len(x[0]) for x in lines])
    free = np.array([min(x[1], len(x[0])) * (WEIGHT if x[2] else 1) for x in lines])
    ones = np.ones(BLOCK, np.int64)
    sums = np.convolve(lengths, ones)[: len(lines)]  # a window that ends at each line
    # surge: a window with text after an empty one; dive: the first empty window after it
    text = np.concatenate([[False], sums > 0, [False]])
    surges, dives = np.flatnonzero(text[1:-1] & ~text[:-2]), np.flatnonzero(~text[1:] & text[:-1])
    stretches = list(zip(surges.tolist(), dives.tolist(), strict=True))
    peak = lambda a, b: int(np.convolve(free[a:b], ones).max())
    peaks = [peak(a, b) for a, b in stretches]
    out: list[str] = []
    for (a, b), most in zip(stretches, peaks, strict=True):
        if most > SURGE or most == max(peaks):
            out.extend(kept_lines(lines[a:b], peak, a))
    return " ".join(out)


def kept_lines(lines: list, peak: Callable[[int, int], int], first: int) -> list[str]:
    """Lines of a kept stretch, which starts at line ``first`` of the page."""
    numbers = np.array([x[3] for x in lines])
    starts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
    sections = list(zip(starts, [*starts[1:], len(lines)], strict=True))
    alone = [k for k, (a, b) in enumerate(sections) if peak(first + a, first + b) > SURGE]
    if alone:
        sections = [(a, b) for k, (a, b) in enumerate(sections) if alone[0] <= k <= alone[-1] or any(x[4] for x in lines[a:b])]
    # links weigh nothing; within an article they are its text
    own = [(a, b) for a, b in sections if 2 * sum(min(x[1], len(x[0])) for x in lines[a:b]) >= sum(len(x[0]) for x in lines[a:b]) or any(x[2] for x in lines[a:b])]
    return [x[0] for a, b in own or sections for x in lines[a:b] if x[0]]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """``page_id``, ``url`` (null if there is no such column), ``text`` and ``n_chars`` of every page."""

    def run(batches):
        for batch in batches:
            html = batch.column(2).to_pylist()
            for a, b in blocks(html):
                texts = [main_text(h) for h in html[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    url = pages[url_col].cast("string") if url_col else F.lit(None).cast("string")
    return pages.select(pages[id_col].cast("bigint"), url, F.coalesce(pages[html_col].cast("string"), F.lit(""))).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
