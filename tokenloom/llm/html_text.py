"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element's text; scripts, styles, forms and what
its tag, role, id or class marks as a menu, header, footer, sidebar, notice, advert or reader comment
leave empty lines only. The distribution is the sum of text lengths over a sliding window of lines,
words inside links not counted, as menus are made of them. Text surges where a sum above zero
follows an empty window and dives where the sum is zero again; a surge that stays below
``SURGE`` characters in every window is no article unless the page has no other.

The heaviest surge lies in the article. Its borders are those of the element that holds it: the
nearest ``article`` or ``main``, else the smallest element around it that is not the whole page, so a
short first or last paragraph stays. On a page without such an element the text between surge
and dive is kept as it is.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import map_rows

WINDOW = 3
SURGE = 80
DEPTH = 512  # open elements; deeper ones count as text of the one around them, as in browsers

# Element and name lists of HTML and of common page templates.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = RAW | frozenset(
    "head nav footer aside form button select svg math object applet audio video canvas map menu noscript template dialog".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# an open element that a new one of the key closes, up to the nearest element of the second set
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "body": ({"head"}, {"body"}),
}
MARKS = frozenset(
    "ad ads adbox adslot adunit adsense advert adverts advertisement advertisements advertising banner sponsor sponsored promo "
    "promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars rail header masthead topbar footer "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup "
    "login search searchbox share sharing social related recommended recommendations comment comments commentlist "
    "commentary disqus respond reply replies discussion widget widgets toolbar pagination pager skip copyright".split()
)
ALWAYS = frozenset(
    "advert adverts advertisement advertisements advertising comment comments commentlist cookie cookies sidebar disqus".split()
)
CONTENT = frozenset("content article post entry main body story text page wrapper container layout".split())
UNLESS = frozenset("has with no without hide".split())
WHOLE = frozenset("html body".split())
HOLDERS = frozenset("article main section div td blockquote center".split())

# quoted attribute values may hold ">"; after 400 pieces a tag ends at the next one, so that stray
# quotes cost no more than that
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'){0,400}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marks_boilerplate(tag: str, attributes: str) -> bool:
    """Whether an element's role, id or class names it as something beside the article."""
    if tag in WHOLE or tag in ("article", "main"):
        return False
    found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in DROPPED_ROLES or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I):
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in _WORD.findall(name)]
        if not parts or UNLESS & set(parts):
            continue
        if parts[-1] == "header" and parts[0] in CONTENT:
            continue
        if ALWAYS & set(parts) or parts[-1] in MARKS or (parts[0] in MARKS and parts[-1] not in CONTENT):
            return True
    return False


class _Open:
    """An open element: what its text is in."""

    __slots__ = ("article", "hard", "holder", "link", "soft", "tag")

    def __init__(self, tag: str, above: _Open | None, holder: int | None, article: int | None, dropped: bool):
        self.tag = tag
        self.holder = holder if holder is not None else above.holder if above else 0
        self.article = article if article is not None else above.article if above else -1
        # an article's own header keeps its headings
        own = tag == "header" and self.article >= 0
        self.hard = dropped or bool(above and above.hard) or (tag == "header" and not own)
        self.soft = (own or bool(above and above.soft)) and tag not in HEADINGS
        self.link = bool(above and above.link) or tag == "a"

    @property
    def dropped(self) -> bool:
        return self.hard or self.soft


class Page:
    """The lines of a page in order, with the elements they are in."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        self.weights: list[int] = []  # characters outside links; 0 for what was dropped
        self.holders: list[int] = []
        self.articles: list[int] = []
        self.parents = [-1]  # of each holder; holder 0 is the page
        self._text: list[str] = []
        self._weight = 0
        self._gap = False
        self._read(source)

    def _flush(self, at: _Open | None) -> None:
        if not self._text:
            return
        line = " ".join(html.unescape("".join(self._text)).split())
        if line:
            if self._gap:
                for _ in range(WINDOW):
                    self._line("", 0, 0, -1)
                self._gap = False
            self._line(line, min(self._weight, len(line)), at.holder if at else 0, at.article if at else -1)
        self._text, self._weight = [], 0

    def _line(self, text: str, weight: int, holder: int, article: int) -> None:
        self.lines.append(text)
        self.weights.append(weight)
        self.holders.append(holder)
        self.articles.append(article)

    def _say(self, text: str, at: _Open | None) -> None:
        if at is not None and at.dropped:
            self._gap = self._gap or not text.isspace()
        elif text:
            self._text.append(text)
            if not (at and at.link):
                self._weight += len(text.strip())

    def _read(self, source: str) -> None:
        stack: list[_Open] = []
        done = 0
        while True:
            token = _TOKEN.search(source, done)
            top = stack[-1] if stack else None
            end = token.start() if token else len(source)
            if end > done:
                self._say(source[done:end], top)
            if not token:
                break
            done = token.end()
            tag = (token[2] or token[5] or "").lower()
            if not tag:
                continue
            if token[1] or token[4]:
                self._close(tag, stack)
                continue
            attributes = token[3] or token[6] or ""
            if tag == "br":
                self._say(" ", top)
                continue
            if tag in BLOCK:
                self._flush(top)
                self._imply(tag, stack)
                top = stack[-1] if stack else None
            if tag in VOID:
                continue
            if tag in RAW:
                stop = _RAW_END[tag].search(source, done)
                self._gap = self._gap or tag == "textarea"
                done = stop.start() if stop else len(source)
                if stop:
                    done = source.find(">", done) + 1 or len(source)
                continue
            if len(stack) >= DEPTH:
                continue
            holder = article = None
            if tag in HOLDERS:
                self.parents.append(top.holder if top else 0)
                holder = len(self.parents) - 1
                if tag in ("article", "main") or re.search(r"""role\s*=\s*["']?main""", attributes, re.I):
                    article = holder
            stack.append(_Open(tag, top, holder, article, tag in DROPPED or (bool(attributes) and marks_boilerplate(tag, attributes))))
        self._flush(stack[-1] if stack else None)

    def _imply(self, tag: str, stack: list[_Open]) -> None:
        """Closes what a new block element ends without a tag of its own."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == "p":
                del stack[i:]
                break
            if stack[i].tag in BLOCK:
                break
        if tag in CLOSES:
            ended, until = CLOSES[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ended:
                    del stack[i:]
                    if tag != "tr":
                        break

    def _close(self, tag: str, stack: list[_Open]) -> None:
        block = tag in BLOCK
        if block:
            self._flush(stack[-1] if stack else None)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                break
            if not block and stack[i].tag in BLOCK:
                break
            if tag == "p" and stack[i].tag in BLOCK:
                break


def surges(weights: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(first line, line after the last, greatest window)`` of every stretch between a surge and its dive."""
    n = len(weights)
    if not n:
        return []
    total = np.concatenate([[0], np.cumsum(weights)])
    start = np.arange(-window + 1, n)
    sums = total[np.minimum(start + window, n)] - total[np.maximum(start, 0)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        # windows from a on see the first line only at their end
        lines = np.flatnonzero(weights[max(start[a], 0) : min(start[b - 1] + window, n)]) + max(int(start[a]), 0)
        out.append((int(lines[0]), int(lines[-1]) + 1, int(sums[a:b].max())))
    return out


def main_text(source: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article of a page: its blocks in order, one line feed between two."""
    page = Page(source or "")
    weights = np.array(page.weights, dtype=np.int64)
    found = surges(weights, window)
    if not found:
        return ""
    high = [s for s in found if s[2] >= surge] or found
    total = np.concatenate([[0], np.cumsum(weights)])
    best = max(high, key=lambda s: total[s[1]] - total[s[0]])
    holder = _holder_of(page, weights, *best[:2])
    if holder:
        inside = {holder}
        for h in range(holder + 1, len(page.parents)):  # a holder comes after the one around it
            if page.parents[h] in inside:
                inside.add(h)
        keep = [i for i, h in enumerate(page.holders) if h in inside]
    else:
        keep = [i for a, b, _ in high for i in range(a, b)]
    return "\n".join(page.lines[i] for i in keep if page.lines[i])


def _holder_of(page: Page, weights: np.ndarray, a: int, b: int) -> int:
    """The element that holds the lines from ``a`` to ``b``; 0 if that is the page."""
    mass: dict[int, int] = {}
    for i in range(a, b):
        if page.articles[i] >= 0:
            mass[page.articles[i]] = mass.get(page.articles[i], 0) + int(weights[i])
    if mass and 2 * sum(mass.values()) >= int(weights[a:b].sum()):
        best = max(mass, key=lambda h: mass[h])
        # the outermost article around the heaviest
        outer, up = best, page.parents[best]
        known = set(page.articles)
        while up > 0:
            outer, up = up if up in known else outer, page.parents[up]
        return outer
    common: list[int] | None = None
    for i in range(a, b):
        if page.lines[i]:
            chain, h = [], page.holders[i]
            while h > 0:
                chain.append(h)
                h = page.parents[h]
            common = chain if common is None else [h for h in common if h in set(chain)]
    return common[0] if common else 0


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Character references are decoded, white space inside a block is one space. A null or empty
    ``html``, or one without text, has an empty text; a page without tags is its own text.
    Repeated rows give equal rows, ids and urls pass as they are. Nothing is shuffled.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(source, window, surge) for source in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select("page_id", "url", F.col("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_rows(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
