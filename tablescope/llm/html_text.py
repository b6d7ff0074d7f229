"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams its events into lines (blocks: paragraphs, headings, list items, table rows).  Each
line has a ratio, its characters by its tags; ratios are smoothed along the page by a Gaussian window and split into two
clusters by a threshold (two means on a logarithmic scale).  Lines of the upper cluster vote, by their characters, for the
innermost element that holds most of them; an ``article`` or ``main`` around it is taken in its stead, or all of those
inside it that got votes, if they hold as large a share together
or a single line of up to ``LONE`` characters stands outside them.  The text is every line of that element, however short, so a
paragraph of one word is kept; if no ``article`` or ``main`` marks the content, lines of the upper cluster outside the element count
too where their box holds more than ``LONE`` characters of such lines, so a notice in a plain box of its own does not.
A byline in an article's own header goes, its headings stay.

What says what it is does not take part: scripts, styles, menus, footers, side bars, forms, page headers, and elements whose
class, id or role names an advert, notice, menu, comment section or the like; inside a line, elements that are hidden or named
as adverts or notices.  Words in class and id of boxes and lines do not count on a page
where they would take the wanted share of the upper cluster.  A head without end tag ends at the first element of the
body, other silent elements at the latest where the element around them does.

Lines know their innermost element and elements their parent, so time and memory grow with the page, not with its depth.

Null or empty html, and pages without text, give an empty text.  White space inside a line becomes one space, lines are
joined by a line feed; nothing else is shortened.  A tag or comment that the page's end cuts off is left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMA = 1.0  # lines
VOTE = 0.8  # share of the upper cluster's characters that the element holds
LONE = 200  # characters of a line that does not outvote an article
#: Names of HTML elements by their role, and words that mark what is not content.
SILENT = frozenset("script style noscript template head title svg canvas iframe object select option button textarea".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
IN_HEAD = frozenset("head html base link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOXES = frozenset(
    "html body div section article main aside nav header footer form ul ol dl table thead tbody tfoot tr figure blockquote details fieldset dialog menu center".split()
)
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption summary legend hr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial banner promo promotion promoted sponsor sponsored cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar sidenav widget widgets footer masthead comment comments commentlist disqus replies respond related recommended share "
    "sharing social login search searchbox pagination pager toolbar copyright skip hidden".split()
)
INLINE_MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising advertorial promo promoted sponsor sponsored cookie cookies consent gdpr popup hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORD = re.compile(r"[a-z0-9]+")


SOFT = 2  # left out for a word in class or id alone


def _marked(attrs, marks: frozenset = MARKS) -> int:
    """0, 1 or ``SOFT``."""
    soft = 0
    for name, value in attrs:
        if name == "hidden" or (name == "role" and (value or "").lower() in ROLES) or (name == "aria-hidden" and value == "true"):
            return 1
        if name == "style" and "display:none" in (value or "").replace(" ", "").lower():
            return 1
        if name in ("class", "id") and value:
            for one in value.lower().split():
                words = _WORD.findall(one)
                if not marks.isdisjoint(words) and not {"has", "with", "no", "without", "content", "layout"} & set(words):
                    soft = SOFT
    return soft


class Page(HTMLParser):
    """Collects lines: text, tags, whether left out, and the innermost element around, as a number that grows inwards."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.main: dict[int, str] = {}  # article and main elements
        self.parent: list[int] = [0]  # of each element
        self.open: list[tuple[str, int, int]] = [("", 0, 0)]  # element, number, left out
        self.depth: Counter[str] = Counter()  # open elements by name; "" counts those that are in ``main``
        self.silent, self.text, self.tags, self.heading = 0, [], 0, False
        self.silent_tag, self.line_tag, self.within = "", "", {}

    def _line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, number, out = self.open[-1]
                out = int(not self.heading and self.depth["header"] > 0) or out
                self.lines.append((text, self.tags, out, number))
                self.tags = 0
            self.text = []

    def _enter(self, tag: str, out: int, main: bool = False) -> None:
        number = len(self.parent)
        self.parent.append(self.open[-1][1])
        self.open.append((tag, number, out))
        self.depth[tag] += 1
        if main:
            self.main[number] = tag
            self.depth[""] += 1

    def _leave(self, k: int) -> None:
        """Close the open elements from place ``k`` on."""
        for tag, number, _ in self.open[k:]:
            self.depth[tag] -= 1
            self.depth[""] -= number in self.main
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if self.silent and self.silent_tag == "head" and tag not in IN_HEAD:
            self.silent = 0  # its end tag may be left out
        if self.silent and tag == self.line_tag and self.silent_tag not in SILENT:
            self.silent = 0  # the line that a marked element is in ends where the next begins
        if self.silent:
            self.silent += tag == self.silent_tag
            self.within[tag] = self.within.get(tag, 0) + 1
            return
        self.tags += 1
        if tag in SILENT:
            self.silent, self.silent_tag, self.within = 1, tag, {}
        elif tag == "br":
            self.text.append(" ")
        elif tag in BOXES:
            self._line()
            self.heading, self.line_tag = False, ""
            out = self.open[-1][2]
            if tag in ("article", "main"):
                out = out if tag == "article" or "main" in self.main.values() else 0
                out = 1 if out == 1 else _marked(attrs) or out
            elif tag not in ("html", "body"):
                hard = tag in OUTSIDE or (tag == "header" and not self.depth[""])
                out = 1 if out == 1 or hard else _marked(attrs) or out
            self._enter(tag, out, main=tag in ("article", "main") and not out)
        elif tag in LINES:
            if tag in ("td", "th"):
                self.text.append(" ")
                return
            self._line()
            self.heading, self.line_tag = tag in HEADINGS, tag
            if attrs and (out := _marked(attrs)):
                self._enter(tag, 1 if self.open[-1][2] == 1 else out)
        elif attrs and tag not in VOID and _marked(attrs, INLINE_MARKS):
            self.silent, self.silent_tag, self.within = 1, tag, {}

    def handle_startendtag(self, tag, attrs):
        if tag == "svg":  # the slash ends an element of SVG
            self.tags += not self.silent
        else:
            self.handle_starttag(tag, attrs)  # as browsers do, the slash says nothing

    def handle_endtag(self, tag):
        if self.silent:
            if tag == self.silent_tag:
                self.silent -= 1
                return
            if self.within.get(tag):
                self.within[tag] -= 1
                return
            if tag != self.line_tag and not self.depth[tag]:
                return
            self.silent = 0  # the element around it ends
        self.tags += 1
        if tag in BOXES or (tag in LINES and tag not in ("td", "th")):
            self._line()
            self.heading, self.line_tag = False, ""
            for k in range(len(self.open) - 1, 0, -1) if self.depth[tag] else ():
                if self.open[k][0] == tag:
                    self._leave(k)
                    break
                if tag in LINES and self.open[k][0] in BOXES:
                    break

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)

    def inside(self, chosen) -> list[bool]:
        """For each element, whether it is one of ``chosen`` or in one."""
        out: list[bool] = []
        for number, above in enumerate(self.parent):
            out.append(number in chosen or (number > 0 and out[above]))
        return out


def _smoothed(ratios: list[float]) -> list[float]:
    reach = math.ceil(2 * SIGMA)
    window = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    n, out = len(ratios), []
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        part = window[lo - i + reach : hi - i + reach]
        out.append(sum(w * r for w, r in zip(part, ratios[lo:hi])) / sum(part))
    return out


def _threshold(values: list[float]) -> float:
    """Between two means."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            return cut
        after = sum(below) / len(below), sum(above) / len(above)
        if after == (low, high):
            break
        low, high = after
    return (low + high) / 2


def _whole(html: str) -> str:
    """Without a comment or tag that the end cuts off."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0 and html.find("</script", at) < 0:
        html = html[:at]
    at = html.rfind("<")
    if at >= 0 and html.find(">", at) < 0 and (html[at + 1 : at + 2].isalpha() or html[at + 1 : at + 2] in ("/", "!", "?", "")):
        html = html[:at]
    return html


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(_whole(html))
    page.close()
    page._line()
    ratios = [0.0 if out == 1 else math.log1p(len(text) / max(1, tags)) for text, tags, out, _ in page.lines]
    if ratios:  # class words do not count where they would take the wanted share of the upper cluster
        smooth = _smoothed(ratios)
        cut = _threshold(smooth)
        upper = [x for x, s in zip(page.lines, smooth) if s >= cut and x[2] != 1]
        if sum(len(x[0]) for x in upper if x[2]) >= VOTE * sum(len(x[0]) for x in upper):
            page.lines = [(text, tags, out == 1, around) for text, tags, out, around in page.lines]
    lines = [x for x in page.lines if not x[2]]
    if not lines:
        return ""
    ratios = [0.0 if out else math.log1p(len(text) / max(1, tags)) for text, tags, out, _ in page.lines]
    smooth = _smoothed(ratios)
    cut = _threshold(smooth)
    upper = [x for x, s in zip(page.lines, smooth) if s >= cut and not x[2]] or lines
    votes = [0] * len(page.parent)
    for text, _, _, number in upper:
        votes[number] += len(text)
    own = list(votes)  # of lines with no element between
    for number in range(len(votes) - 1, 0, -1):
        votes[page.parent[number]] += votes[number]
    need = VOTE * votes[0]
    element = max(n for n, v in enumerate(votes) if v >= need)  # numbers grow inwards
    outer = element
    while outer and outer not in page.main:
        outer = page.parent[outer]
    named = {outer} if outer else set()
    if not named:  # marked elements that hold the wanted share of the votes among them: all that got any
        named = {n for n in page.main if votes[n]}
        within = page.inside(page.main)
        outside = [x[0] for x in upper if not within[x[3]]]
        if votes[0] - sum(map(len, outside)) < need and (len(outside) > 1 or len(outside[0]) > LONE):
            named = set()
    if named:
        within = page.inside(named)
        kept = [x for x in lines if within[x[3]]]
    else:
        within, chosen = page.inside({element}), set(map(id, upper))
        kept = [x for x in lines if within[x[3]] or (id(x) in chosen and own[x[3]] > LONE)]
    return "\n".join(x[0] for x in kept)


def extracted(html: Column) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def text(column):
        import pyarrow as pa

        return pa.array(map(main_text, column.to_pylist()), pa.string())

    return text(html.cast("string"))
