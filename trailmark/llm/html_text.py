"""Main text of web pages by line-block distribution (operator 6).

Markup is stripped into lines, one for each block, in page order. Elements that are never article
text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) are
told by tag, role, class or id and make no lines. A line weighs its letters, or nothing where they
are mostly links. Where the page marks its article or main part (by element, role or itemprop), a
line inside weighs ``SURGE`` more and a line outside nothing, so that a mark is evidence that the
sums carry. Weights are summed over windows of ``WINDOW`` lines (Chen, "General web page text
extraction based on line-block distribution", 2009): on every page the text starts where the sums
reach ``SURGE`` and ends where they fall under ``DIVE``, and all lines of some weight between are
kept. Kept blocks are joined by two line ends.

A page is one row and one pass; nothing is shuffled.

Defined results: null and empty pages have an empty text; pages without any article keep nothing;
broken markup ends at the next sound tag; a section without an end tag is not taken out; repeated
rows are treated each; other columns pass through ``extracted``.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import spread

WINDOW, SURGE, DIVE = 3, 80, 20

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# fixed values: names of HTML elements and usual names of page parts
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
NEVER = frozenset("head nav footer aside form menu select button dialog fieldset svg math object audio video canvas map datalist".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
PARTS = frozenset(
    "nav navbar navigation menu submenu masthead header footer sidebar widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert comment comments reply replies discussion disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search breadcrumb breadcrumbs pagination pager popup modal overlay toolbar skip copyright legal disclaimer tagcloud outbrain taboola".split()
)
#: words that turn a name of a part into a state of what holds it ("with-sidebar", "menu-open")
STATES = frozenset("with without has no open closed enabled disabled layout".split())
#: words that make a header the article's own
TITLED = frozenset("article post entry story".split())
#: parts whose own articles are not the page's
LISTS = frozenset("comment comments reply replies discussion related recommended widget widgets sidebar".split())
#: parts' words that name subjects as well: in an article they tell no part by themselves
SUBJECTS = frozenset("discussion legal disclaimer social notice notices notification alert consent promotion search copyright".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _names(attributes: str) -> tuple[list[list[str]], str, bool]:
    """The words of each class and of the id, the role, and whether it is hidden."""
    names: list[list[str]] = []
    role, hidden = "", False
    if "=" not in attributes and "hidden" not in attributes:
        return names, role, hidden
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            names += [w for x in value.split() if (w := [y for y in re.split(r"[^a-z0-9]+", x) if y])]
        elif name == "role":
            role = value.strip()
        elif name == "itemprop" and "articlebody" in value:
            role = "article"
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return names, role, hidden


def _part(names: list[list[str]], in_article: bool) -> set[str]:
    """The kinds of page part that names say: a part's word first or last in one of them."""
    found: set[str] = set()
    if ["layout"] in names:  # it holds the parts that its other names tell of
        return found
    for words in names:
        hit = {words[0], words[-1]} & PARTS
        if in_article and len(words) == 1:
            hit -= SUBJECTS
        if hit and not STATES.intersection(words) and not (hit == {"header"} and (in_article or TITLED.intersection(words))):
            found |= hit
    return found


class _Lines:
    def __init__(self) -> None:
        self.text: list[str] = []
        self.inside: list[int] = []  # 2 in an article, 1 in a main part
        self.linked: list[int] = []  # letters in links
        self.heading: list[bool] = []
        self.parts: list[str] = []
        self.link = 0

    def end(self, inside: int, heading: bool) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.text.append(text)
            self.inside.append(inside)
            self.linked.append(self.link)
            self.heading.append(heading)
        self.parts, self.link = [], 0


def lines(page: str) -> _Lines:
    out, at, n = _Lines(), 0, len(page)
    low = page.lower() if page.isascii() else page.translate(_LOWER)
    article = main = anchor = 0
    marked: list[list] = []  # open elements that a role or itemprop marks: name, depth, whether an article
    closes: dict[str, int] = {}  # where the next end tag of a name is
    heading = False

    def closing(name: str) -> int:
        if -1 < closes.get(name, 0) < at or name not in closes:
            closes[name] = low.find(f"</{name}", at)
        return closes[name]

    skip, depth, kinds = "", 0, set()
    while at < n:
        m = _TAG.search(page, at)
        upto = m.start() if m else n
        if upto > at and not skip:
            t = entities.unescape(page[at:upto])
            out.parts.append(t)
            if anchor:
                out.link += len(t.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not skip:
                out.parts.append(m[0][9:].removesuffix("]]>"))
            continue
        close, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if skip:
            if name == skip:
                depth += -1 if close else not attributes.endswith("/")
            inner = not close and depth and name in ("article", "main") and not kinds & LISTS and not _part(_names(attributes)[0], False)
            if depth and not inner:
                continue
            skip, depth = "", 0
            if close:
                continue
        if close:
            if name in BLOCKS:
                out.end(2 if article else 1 if main else 0, heading)
                article, main = article - (name == "article" and article > 0), main - (name == "main" and main > 0)
                if marked and marked[-1][0] == name:
                    marked[-1][1] -= 1
                    if not marked[-1][1]:
                        _, _, is_article = marked.pop()
                        article, main = article - is_article, main - (not is_article)
                heading = False
                anchor = 0
            elif name in ("td", "th"):
                out.parts.append(" ")
            elif name == "a":
                anchor = 0
            continue
        names, role, hidden = _names(attributes)
        if name in BLOCKS:
            out.end(2 if article else 1 if main else 0, heading)
            heading = name in ("h1", "h2")
        elif name in ("br", "td", "th"):
            out.parts.append(" ")
        if name in VOID or attributes.endswith("/"):
            continue
        kinds = _part(names, article > 0) if name not in HEADINGS else set()
        part = name in NEVER or name == "header" and not article or role in ROLES or hidden or kinds
        if part and name not in ("html", "body", "main"):
            ends = closing(name)
            if ends < 0 and name not in RAW:
                continue
            if name == "form" and not (role in ROLES or hidden or kinds) and 2 * (ends - at) > n - max(low.find("<body"), 0):
                continue  # it wraps the page
            if name in RAW:
                at = page.find(">", ends) + 1 if ends >= 0 else n
                at = at or n
            elif name == "head" and 0 <= (body := low.find("<body", at)) < ends:
                at = body
            else:
                skip, depth = name, 1
        elif name == "article":
            article += 1
        elif name == "main":
            main += 1
        elif role in ("article", "main") and name in BLOCKS:
            marked.append([name, 1, role == "article"])
            article, main = article + (role == "article"), main + (role == "main")
        elif name == "a":
            anchor = 1
        elif marked and marked[-1][0] == name:
            marked[-1][1] += 1
    out.end(2 if article else 1 if main else 0, heading)
    return out


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def weights(x: _Lines) -> np.ndarray:
    """Letters of each line, as evidence of the article: links count nothing, and a mark as much as a surge."""
    n = np.array([len(t) for t in x.text], np.int64)
    inside = np.array(x.inside)
    level = int(inside.max()) if len(inside) else 0
    if level:
        return np.where(inside == level, n + SURGE, 0)
    return np.where(2 * np.array(x.linked, np.int64) >= n, 0, n)


def distribution(n: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which lines lie between a surge and a dive of the sums over windows of lines, and have a weight."""
    sums = np.convolve(n, np.ones(window, np.int64))[window - 1 :][: len(n)]  # of each line and those after it
    keep = np.zeros(len(n), bool)
    inside = False
    for i, s in enumerate(sums.tolist()):
        inside = s >= SURGE or inside and s >= DIVE
        keep[i] = inside
    return keep & (n > 0)


def extract(page: str | None) -> str:
    """The article's blocks, joined by two line ends."""
    if not page:
        return ""
    x = lines(page)
    if not x.text:
        return ""
    keep = distribution(weights(x))
    if not max(x.inside):  # the heading above the text
        first = int(np.argmax(keep)) if keep.any() else 0
        for i in range(max(0, first - WINDOW), first):
            keep[i] |= x.heading[i]
    return "\n\n".join(t for t, k in zip(x.text, keep.tolist(), strict=True) if k)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars to each page; columns of these names are replaced, and the markup is left out."""
    own = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages
    names = [c for c in own.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return spread(own).mapInArrow(run, T.StructType([*(f for f in own.schema.fields if f.name != html), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    return extracted(pages.select("page_id", "url", "html"))
