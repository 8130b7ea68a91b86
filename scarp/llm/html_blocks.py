"""Main text of web pages by two-pass block rules.

A page is cut into blocks, the text between block-level tags. What structure marks as no article (menus, footers, forms,
scripts, adverts, comments and the like, by element, role, class or id) is left out, unless the element is a wrapper that holds
the story: all marks of an article, a heading of level 1 or half of the page's text that is no link. Pass one decides the other blocks by
link density, length and density of stop words: running text and long blocks are good, link lists are bad, the rest is ambiguous.
Pass two gives each ambiguous block the label of its nearest decided neighbour, a heading that of the next one. Where the
page's marks of an article (``article`` or ``main``) hold at least half of its running text, they decide what is ambiguous:
good inside, bad outside, and running text outside needs a run of half the article's size to count. Good blocks are joined by a line feed, in the order of the page.

Null html counts as empty; a page without text gives the empty string. Repeated rows stay rows. An element that is never
closed loses no more than its own block. An empty table gives an empty result. Time is linear in the page, however its tags nest;
a page is held whole. Columns other than page_id, url and html are not read.
"""
from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarp.llm.texts import raw_texts

# Elements and words that mark structure, and frequent words of four languages.
_RAW = {"script", "style", "xmp", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "svg", "math", "canvas"}
_NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "datalist", "fieldset", "dialog", "menu", "object", "audio",
          "video", "map", "applet"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "figcaption",
          "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "dialog", "footer", "nav", "aside", "form",
          "fieldset", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MARKS = set("""ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs consent contentinfo
cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice
notification overlay pager pagination paywall popup promo promotion recommended related replies reply respond responses search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget complementary""".split())
_STARTS = ("comment", "advert", "sponsor", "cookie", "sidebar", "breadcrumb", "navbar", "newsletter")
_OUTSIDE = {"header", "banner", "masthead"}     # these mark the page's head, but may be the article's own inside of it
_STOP = set("""the and of to in a is that for it was on with as be by this are from or an at not have his they which but had were her
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son
el la que y en los del se las por un para con no una su al lo como más pero sus le ya o este fue ha""".split())

SHORT, LONG = 70, 200               # code points
STOP_LOW, STOP_HIGH = 0.05, 0.12
MAX_LINKS = 0.35
NEAR = 3                            # blocks
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_STATE = re.compile(r"^(?:has|no|with|without|is)[-_]|[-_](?:open|closed|enabled|disabled|on|off)$", re.I)    # tells how a page is laid out
_ARTICLE = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
_TITLE = re.compile(r"<h1(?=[\s/>])", re.I)
_SHUT = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)")
_NO_STORY = {"script", "style", "nav", "footer", "a", "noscript", "template", "select"}
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    text: str
    links: int          # of its code points
    inside: bool        # in the page's article
    heading: bool


class _Tree:
    """One pass over a page: where elements end, and running totals of text, so that what an element holds is a subtraction."""

    def __init__(self, page: str, closed: dict[str, int]):
        self.ends: dict[int, int] = {}          # end of a start tag -> start of its end tag
        self.at, self.sizes = [0], [0]          # text up to a place, without links and what is no text
        self.articles = [m.start() for m in _ARTICLE.finditer(page)]
        self.titles = [m.start() for m in _TITLE.finditer(page)]
        low = page.lower()
        ends: dict[str, list[int]] = {}
        for m in _SHUT.finditer(page):
            if (tag := m[1].lower()) in _NO_STORY:
                ends.setdefault(tag, []).append(m.start())
        open_: dict[str, list[int]] = {}
        at = hidden = 0
        while at < len(page):
            m = _TAG.search(page, at)
            end = m.start() if m else len(page)
            if end > at and at >= hidden and (size := len(" ".join(page[at:end].split()))):
                self.at.append(end)
                self.sizes.append(self.sizes[-1] + size + 1)
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if starts := open_.get(tag):
                    self.ends[starts.pop()] = m.start()
                continue
            open_.setdefault(tag, []).append(at)
            if tag in _NO_STORY and at >= hidden:
                known = ends.get(tag, [])
                if (i := bisect_left(known, at)) < len(known):
                    hidden = known[i]
            if tag in _RAW and tag != "title":      # a title counts as text of the page
                at = _raw_end(page, low, closed, tag, at)

    def _size(self, at: int) -> int:
        return self.sizes[bisect_right(self.at, at) - 1]

    def holds_story(self, at: int, own_head: bool) -> bool:
        """Whether the element whose start tag ends at ``at`` is a wrapper: it holds all marks of an article, a heading of level 1 or half
        of the text. An element that is never closed holds nothing."""
        end = self.ends.get(at)
        if end is None:
            return False
        marks = bisect_left(self.articles, end) - bisect_left(self.articles, at)
        if (marks and marks == len(self.articles)) or (not own_head and bisect_left(self.titles, end) > bisect_left(self.titles, at)):
            return True
        size = self._size(end) - self._size(at)
        return size > SHORT and 2 * size >= self.sizes[-1]


def _raw_end(page: str, low: str, closed: dict[str, int], tag: str, at: int) -> int:
    """Where the content of an element that holds no markup ends."""
    if closed.get(tag, -1) < at:
        return len(page) if tag in ("script", "style") else at
    end = low.find(f"</{tag}", at) if len(low) == len(page) else -1
    return end if end >= 0 else re.compile(f"</{tag}", re.I).search(page, at).start()


def _left_out(tag: str, attrs: str, inside: bool) -> str:
    """How structure marks an element as no article: "surely", "head" or "maybe" if it may be a wrapper, "" if not."""
    if tag in ("form", "fieldset"):
        return "maybe"
    if tag in _NEVER or (tag == "header" and not inside):
        return "surely"
    if not attrs.strip():
        return ""
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "surely"
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "surely"
        elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            named = [w for w in value.split() if not _STATE.search(w)]
            parts = {p.lower() for w in named for p in _SPLIT.findall(w)} | {p for w in named for p in _PART.findall(w.lower())}
            marks = parts & _MARKS | ({"header"} & parts)
            if inside:
                marks -= _OUTSIDE
            if marks or any(p.startswith(_STARTS) for p in parts):
                return "head" if marks & (_OUTSIDE | {"header"}) else "maybe"
    return ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page that structure leaves in."""
    out: list[Block] = []
    parts: list[str] = []
    links = 0           # code points of the open block's links
    in_link = depth = 0
    heading = ""
    gone = ""           # the element that is being left out
    nested = 0
    low = tree = None
    closed = {m[1].lower(): m.start() for m in _SHUT.finditer(page)}        # the last end tag of each name

    def close() -> None:
        nonlocal links, in_link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), depth > 0, bool(heading)))
            parts.clear()
        links = in_link = 0

    at = 0
    while (m := _TAG.search(page, at)) or at < len(page):
        if not gone and (end := m.start() if m else len(page)) > at:
            text = html.unescape(page[at:end])
            parts.append(text)
            if in_link:
                links += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        shut, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not shut and tag in _RAW:
            low = page.lower() if low is None else low
            at = _raw_end(page, low, closed, tag, at)
            continue
        if gone == "p" and tag in _BLOCK:       # its end tag may be missing: any other block ends it
            gone = ""
            if shut and tag == "p":
                continue
        elif gone == "li" and tag in ("li", "ul", "ol"):
            nested += (tag != "li") * (-1 if shut else 1)
            if nested < 1 or (tag == "li" and nested == 1):     # the item's end, the next item or the end of the list
                gone = ""
                if shut and tag == "li":
                    continue
        elif gone and tag == gone and gone not in ("p", "li"):
            nested += -1 if shut else 0 if attrs.endswith("/") else 1
            if not nested:
                gone = ""
                continue
        if gone:
            continue
        how = "" if shut or tag in _VOID else _left_out(tag, attrs, depth > 0)
        if how and how != "surely":
            tree = tree or _Tree(page, closed)
        if how and (how == "surely" or not tree.holds_story(at, how == "head")):
            if tag in _BLOCK or tag in _NEVER:
                close()
            gone, nested = tag, 1
            if tag not in ("p", "li") and closed.get(tag, -1) < at:
                gone = "p"          # never closed: only what stands in its own block goes
            continue
        if tag == "a":
            in_link = 0 if shut else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            close()
            if tag in ("article", "main"):
                depth = max(0, depth + (-1 if shut else 1))
            if tag[0] == "h" and tag[1:].isdigit():
                heading = "" if shut else tag
    close()
    return out


def _length(text: str) -> int:
    """Code points; those of scripts without spaces count three times, as each is much of a word."""
    return len(text) if text.isascii() else len(text) + 2 * len(_DENSE.findall(text))


def running(b: Block) -> bool:
    """Whether length or stop words show running text."""
    n = _length(b.text)
    if b.heading or n < SHORT or ("©" in b.text and n < LONG) or b.links > MAX_LINKS * len(b.text):
        return False
    if n >= LONG and b.links <= MAX_LINKS * len(b.text) / 2:
        return True         # whatever its language
    w = b.text.lower().split()
    density = sum(x.strip(".,;:!?\"'()") in _STOP for x in w) / len(w)
    return density >= STOP_HIGH or (density >= STOP_LOW and n >= LONG)


def marks_hold(found: list[Block]) -> bool:
    """Whether the page's marks of an article hold at least half of its running text, or of all text if nothing is running."""
    if not any(b.inside for b in found):
        return False
    sizes = [len(b.text) * running(b) for b in found]
    if not any(sizes):
        sizes = [len(b.text) - b.links for b in found]
    return 2 * sum(x for x, b in zip(sizes, found) if b.inside) >= sum(sizes)


def decide(b: Block, marked: bool) -> bool | None:
    """Pass one: good, bad or, as None, ambiguous. ``marked``: the page's marks of an article hold."""
    if b.links > MAX_LINKS * len(b.text) and not b.heading:
        return None if marked and b.inside else False
    if running(b):
        return True
    if marked:
        return b.inside
    n = _length(b.text)
    if "©" in b.text and n < LONG:
        return False
    return False if not b.heading and n < SHORT and b.links > MAX_LINKS * len(b.text) / 2 else None


def inherit(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass two: ambiguous blocks take the label of the nearest decided neighbour, the one before at equal distance.

    A heading looks ahead first. Where nothing is decided, all is kept. Only a short block near a bad one becomes bad.
    A block of links in the article stays between two good blocks; runs of them go.
    """
    n = len(labels)
    before: list[int | None] = []
    last = None
    for i, x in enumerate(labels):
        last = i if x is not None else last
        before.append(last)
    after: list[int | None] = [None] * n
    last = None
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    out = []
    for i, x in enumerate(labels):
        a, z = before[i], after[i]
        if x is None and not found[i].heading and found[i].links > MAX_LINKS * len(found[i].text):
            x = 0 < i < n - 1 and bool(labels[i - 1] and labels[i + 1])     # a link inside of the article, or one of a run
        if x is None:
            if a is None and z is None:
                x = True
            elif a is None or (z is not None and (found[i].heading or z - i < i - a)):
                x = labels[z]
            else:
                x = labels[a]
            if not x:
                near = min(i - a if a is not None else n, z - i if z is not None else n)
                x = near > NEAR or _length(found[i].text) >= SHORT
        out.append(bool(x))
    return out


def supported(found: list[Block], labels: list[bool | None]) -> list[bool | None]:
    """Where the page's marks of an article hold, running text outside counts only in a run of at least half of the article's text: a
    part of the story that the marks miss does, a reader's comment or a teaser does not."""
    inside = sum(len(b.text) for b, x in zip(found, labels) if x and b.inside and not b.heading)
    out, i = list(labels), 0
    while i < len(found):
        j = i
        while j < len(found) and not found[j].inside and (labels[j] or found[j].heading):
            j += 1
        if 2 * sum(len(b.text) for b in found[i:j]) < inside:
            out[i:j] = [False] * (j - i)
        i = max(j, i + 1)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    marked = marks_hold(found)
    labels = [decide(b, marked) for b in found]
    keep = inherit(found, supported(found, labels) if marked else labels)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(raw.decode("utf-8", "replace")) for raw in raw_texts(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                  ["page_id", "url", "text", "n_chars"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
