"""Operator 8: main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one for each block of the page. A line weighs its length, and the
weights are summed over sliding windows of lines: text begins at the first line of weight in a window
whose sum surges above a threshold, and ends at the last one before the sum dives below a lower
one. What lies between is kept, but for chrome.

What tags, names and the line itself say changes weights and nothing else. Lines inside chrome
(navigation, forms, adverts, comments and the like), links, labels and copyright lines weigh
nothing. A line in a part that the page marks as its main one weighs a surge at least; the others then weigh the
less, the more of the text that part holds: (1 - share) ** FADE of their length. A title or a short sentence weighs just
enough to belong to text that it stands beside; a short line in a paragraph counts as a sentence.

Tags say what is chrome for sure. Names of classes are weaker evidence: only whole names count,
and an element that holds half of the page's text is a wrapper, whatever its name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window; a surge needs this sum, or a quarter of the highest one if that is less; below DIVE the text ends.
WINDOW, SURGE, DIVE = 3, 80, 20
#: Least weight of a text's first and last line; a line shorter than this is a label unless it is or ends as a sentence.
LINE, LABEL = 10, 40
#: Share of a page's text that makes a named element a wrapper; how fast other lines lose weight against a marked main part.
WRAPPER, FADE = 0.5, 3

#: A tag: no `<` outside quotes. Without a match, a tag with a stray quote. Both read each character once.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_STRAY = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>")
#: What stands between `<` and the mark at the end of a comment and the like.
_SPANS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
_RAW = frozenset(
    "script style title textarea template noscript iframe object svg select datalist canvas audio video annotation annotation-xml".split(),
)
#: Without an end tag these run to the end of the page.
_RUNS_ON = frozenset("script style title textarea template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME = frozenset("nav footer aside form menu dialog button fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that mark what isn't the article, those of reader comments, and words that may stand beside them. Fixed values.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside widget widgets header masthead topbar footer copyright share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip".split()
)
_COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
_BEFORE = frozenset("site page main global top bottom left right primary secondary user reader post article".split())
_AFTER = frozenset(
    "bar box block area section container wrapper wrap inner outer list item items link links slot unit top bottom left right main primary secondary post posts form thread feed".split(),
)
_HEADS = frozenset(("header", "footer"))
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SENTENCE = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)\s|copyright\b)|\ball rights reserved\b", re.I)
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SPLIT = re.compile(r"[-_:0-9]+")


def named(value: str) -> tuple[bool, bool]:
    """(chrome, comments): what the names in a class or id say."""
    chrome = comments = False
    for name in _CAMEL.sub(r"\1-\2", value).lower().split():
        parts = [p for p in _SPLIT.split(name) if p]
        hits = [p for p in parts if p in _NAMES or p in _COMMENTS]
        rest = [p for p in parts if p not in hits]
        if not hits or not _HEADS.isdisjoint(hits) and not {"post", "article"}.isdisjoint(rest):
            continue
        first = parts.index(hits[0])
        if all(p in _BEFORE for p in parts[:first]) and all(p in _AFTER or p in hits for p in parts[first:]):
            chrome = True
            comments |= not _COMMENTS.isdisjoint(hits)
    return chrome, comments


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    chrome: bool  # for sure
    named: tuple[int, ...]  # elements around it whose names say chrome
    main: bool  # in a marked main part
    title: bool  # a first-level heading
    paragraph: bool  # in a paragraph, or in no block at all


class Page:
    """The lines of a page, read in one pass over its markup."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, chrome, main, number among the named or -1
        self.opened: Counter = Counter()
        self.chrome = self.main = self.links = self.linked = self.titles = 0
        self.suspects: list[int] = []
        self.comments: list[bool] = []  # for each named element
        self.holds_title: list[bool] = []
        self.buffer: list[str] = []
        self._read(page)
        self._flush()

    def _read(self, page: str) -> None:
        at, end, absent = 0, len(page), set()
        cut = page.rfind("<") if page.rfind("<") > page.rfind(">") else end  # where the page's end may cut off a tag
        while at < end:
            begin = page.find("<", at)
            if begin < 0:
                return self._add(page[at:])
            self._add(page[at:begin])
            span = next((s for s in _SPANS if page.startswith(s[0], begin)), None)
            if span:
                close = -1 if span[1] in absent else page.find(span[1], begin + len(span[0]))
                if close < 0:
                    absent.add(span[1])
                at = end if close < 0 and span[0] == "<!--" else begin + len(span[0]) if close < 0 else close + len(span[1])
                continue
            t = _TAG.match(page, begin) or _STRAY.match(page, begin)
            if not t:
                if begin == cut and page[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
                    return
                self._add("<")
                at = begin + 1
                continue
            at = t.end()
            name = t[2].lower()
            if t[1]:
                self._close(name)
            elif name in _RAW:
                gone = None if name in absent else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if gone:
                    at = gone.end()
                else:
                    absent.add(name)
                    at = end if name in _RUNS_ON else at
            elif name in _VOID:
                if name == "hr":
                    self._flush()
                else:
                    self._add(" ")
            else:
                self._open(name, t[3])

    def _add(self, piece: str) -> None:
        if piece:
            self.buffer.append(piece)
            self.linked += len(piece) if self.links else 0

    def _flush(self) -> None:
        if self.buffer:
            # white space in a reference is text of its own until it is decoded
            text = " ".join(html.unescape("".join(self.buffer)).split())
            if text:
                self.lines.append(Line(text, self.linked, self.chrome > 0, tuple(self.suspects), self.main > 0, self.titles > 0, self.opened["p"] > 0 or not self.stack))
            self.buffer, self.linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        chrome, suspect, comments, main = name in _CHROME or name == "header" and not self.main, False, False, name in ("article", "main")
        if attributes and not attributes.isspace():
            for m in _ATTRIBUTE.finditer(attributes):
                kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if kind == "role":
                    chrome |= value.strip().lower() in _ROLES
                    main |= value.strip().lower() in ("main", "article")
                elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                    chrome = True
                elif kind in ("class", "id") and name not in ("html", "body", "main"):
                    found = named(value)
                    suspect, comments = suspect or found[0], comments or found[1]
        if name == "a":
            self.links = 1
        if name in ("h1", "article", "main"):
            for k in self.suspects:
                self.holds_title[k] = True
        if name in _BLOCK or chrome or suspect:
            self._flush()
            if self.stack and name in _BLOCK and (self.stack[-1][0] == "p" or name == "li" == self.stack[-1][0]):
                self._close(self.stack[-1][0])
            number = -1
            if suspect:
                number = len(self.comments)
                self.comments.append(comments)
                self.holds_title.append(name in ("article", "main"))
                self.suspects.append(number)
            self.stack.append((name, chrome, main, number))
            self.opened[name] += 1
            self.titles += name == "h1"
            self.chrome += chrome
            self.main += main

    def _close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in _BLOCK or self.opened[name]:
            self._flush()
        if not self.opened[name]:
            return
        while True:
            top, chrome, main, number = self.stack.pop()
            self.opened[top] -= 1
            self.titles -= top == "h1"
            self.chrome -= chrome
            self.main -= main
            if number >= 0:
                self.suspects.pop()
            if top == name:
                return

    def wrappers(self) -> set[int]:
        """Named elements that hold the page's text after all, and some of its main part if it marks one."""
        held, main = Counter(), Counter()
        total = marked = 0
        for x in self.lines:
            if not x.chrome:
                total, marked = total + len(x.text), marked + x.main
                for k in x.named:
                    held[k] += len(x.text)
                    main[k] += x.main
        return {k for k, n in held.items() if n >= WRAPPER * total and (self.holds_title[k] or not self.comments[k]) and (main[k] or not marked)}


def weights(lines: list[Line], chrome: list[bool]) -> list[float]:
    """The weight of each line."""
    total = sum(len(x.text) for x, c in zip(lines, chrome, strict=True) if not c)
    share = sum(len(x.text) for x, c in zip(lines, chrome, strict=True) if x.main and not c) / max(1, total)

    def weight(x: Line) -> float:
        if x.main:
            return max(len(x.text), SURGE)
        free, sentence = len(x.text) - x.linked, x.paragraph or _SENTENCE.search(x.text)
        if free <= 0 or _RIGHTS.search(x.text) or len(x.text) < LABEL and not sentence and not x.title:
            return 0
        if x.title:
            return max(free * (1 - share) ** FADE, LINE)
        return max(free, LINE if sentence and not x.linked else 0) * (1 - share) ** FADE

    return [0 if c else weight(x) for x, c in zip(lines, chrome, strict=True)]


def stretches(weights: list[float]) -> list[tuple[int, int]]:
    """(first, last) lines of the text between each surge of the windows' sums and the dive after it."""
    sums = [sum(weights[k : k + WINDOW]) for k in range(len(weights))]
    least = min(SURGE, max(sums, default=0) / 4)
    heavy = lambda a, b: [k for k in range(a, min(b, len(weights))) if weights[k] >= LINE]
    out: list[tuple[int, int]] = []
    begin = None
    for k, s in enumerate(sums):
        if begin is None and s and s >= least:
            begin = next(iter(heavy(k, k + WINDOW)), None)
        if begin is not None and (s < min(DIVE, least) or k == len(sums) - 1):
            out.append((begin, max(heavy(begin, k + WINDOW - 1), default=begin)))
            begin = None
    return out


def extract(page: str) -> str:
    """The main text of a page, one line for each block; '' if there is none."""
    found = Page(page)
    wrappers = found.wrappers()
    chrome = [x.chrome or not wrappers.issuperset(x.named) for x in found.lines]
    weight = weights(found.lines, chrome)
    # runs of chrome count as one line, so that adverts inside the text don't end it
    rows = [k for k in range(len(chrome)) if not (chrome[k] and k and chrome[k - 1])]
    kept = [k for a, b in stretches([weight[k] for k in rows]) for k in rows[a : b + 1]]
    return "\n".join(found.lines[k].text for k in kept if not chrome[k])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html, and pages without text, give ''.

    Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    Very long pages are read whole, in time that grows with their length.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = [extract(h or "") for h in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    schema=schema,
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
