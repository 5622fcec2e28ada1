"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import over_arrow

# Element names of the HTML standard, and words by which pages name what isn't their article.
#: Elements whose whole content is not text of the page.
OPAQUE = frozenset("script style noscript template svg math canvas iframe object embed applet audio video map select textarea button datalist head title".split())
#: Of these, the ones that last to the page's end if nothing closes them.
TO_THE_END = frozenset("script style textarea title template noscript iframe svg".split())
#: Elements whose whole content stands outside an article.
ASIDE = frozenset("nav footer aside menu dialog header search fieldset".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold text, not a part of the page's layout.
TEXTUAL = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address".split())
#: Elements that an unclosed paragraph ends at.
ENDS_P = frozenset("p div article section h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote address figure main nav footer aside form header hr fieldset".split())
#: Elements that end an open one of the same group.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: Words in class and id names for what isn't an article.
BOILER = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner popup modal overlay cookie cookies consent gdpr notice alert disclaimer newsletter subscribe subscription signup login breadcrumb breadcrumbs menu nav navbar navigation toolbar sidebar rail widget related recommended recommendations share sharing social comment comments commentlist commentform respond reply replies disqus footer header masthead copyright legal pagination pager skip search".split())
#: Of these, the ones that hold whatever the text: comments, menus, consent, adverts. Names without one of them only ask.
FIRM = frozenset("ad ads advert adverts advertisement advertising sponsored popup modal cookie cookies consent gdpr newsletter subscribe subscription signup login breadcrumb breadcrumbs menu nav navbar navigation comment comments commentlist commentform respond reply replies disqus footer masthead pagination pager skip".split())
#: Words behind such a word that only say which part of the layout it is.
PARTS = frozenset("area areas article articles bar block body bottom box btn button buttons center column container content dialog first form frame group holder icon icons image inner item items last layer left line link links list main media message module outer panel place policy post posts primary region right row secondary section slot small space stories story strip tab text thread title top unit wide wrap wrapper zone".split())
#: Words in front of such a word that make a name the state of a page.
STATES = frozenset("has no with without is not show hide js".split())
#: Roles whose elements stand outside an article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog toolbar".split())

# The tokens of the HTML standard: an attribute's value is quoted only if it begins with a quote.
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)"
_ATTRIBUTES = rf"(?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+{_VALUE}?+)?+|=)*+"
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"(=?[^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+")
_TOLD = re.compile("class|id|role|hidden|style", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
#: The window's lines, and the sums at which text surges and dives.
WINDOW, SURGE, DIVE = 3, 86, 0
#: A line whose own class says that it is no article counts for so much of its length.
DOUBT = 0.25
#: What markup says of an element: nothing, that its text is doubtful, that it may stand outside the article, or that it does.
FINE, DOUBTFUL, ASKED, OUTSIDE = 0, 1, 2, 3
#: So much plain text within a marked article is article, whatever a name says that only asks.
SUBSTANCE = 2 * SURGE


class Line:
    """A block of the page: its text, the part of it that is link text, whether markup puts it inside an article, what
    markup says against it (FINE, DOUBTFUL, OUTSIDE), and the number of the innermost element around it that asks."""

    __slots__ = ("text", "linked", "main", "said", "asked")

    def __init__(self, text: str, linked: int, main: bool, said: int, asked: int = -1) -> None:
        self.text, self.linked, self.main, self.said, self.asked = text, linked, main, said, asked


class Asking:
    """An element whose name (or <form>) says that it isn't article, unless its text says otherwise: the name, the number of
    the next such element around it, whether it is in a marked article, whether it is the outermost one of its name."""

    __slots__ = ("name", "up", "main", "top")

    def __init__(self, name: str, up: int, main: bool, top: bool) -> None:
        self.name, self.up, self.main, self.top = name, up, main, top


def refused(asking: list[Asking], lines: list[Line]) -> list[bool]:
    """Which of the elements that ask stand outside the article, with all that is in them.

    Not those that hold most of the page's plain text (what is no link and not outside anyway): layout, or a form around
    the page. Nor those that aren't mostly links, if all elements of their name hold most of it, each a paragraph perhaps,
    or if they have some plain text within a marked article. Linear in the page.
    """
    plain, links, total = [0] * len(asking), [0] * len(asking), 0
    for x in lines:
        if x.said != OUTSIDE:
            total += len(x.text) - x.linked
            if x.asked >= 0:
                plain[x.asked] += len(x.text) - x.linked
                links[x.asked] += x.linked
    by_name: Counter[str] = Counter()
    for k in range(len(asking) - 1, -1, -1):
        if asking[k].up >= 0:
            plain[asking[k].up] += plain[k]
            links[asking[k].up] += links[k]
        by_name[asking[k].name] += plain[k] if asking[k].top else 0
    most = lambda mass: mass >= SURGE and 2 * mass > total
    out: list[bool] = []
    for k, a in enumerate(asking):
        fine = most(plain[k]) or (links[k] <= plain[k] and (most(by_name[a.name]) or (a.main and plain[k] >= SUBSTANCE)))
        out.append(not fine or (a.up >= 0 and out[a.up]))
    return out


def names_boilerplate(name: str, alone: bool = False) -> bool:
    """Whether one class or id names what isn't an article: its last word does (`post-comments`), or its first does and
    the others are parts of a layout (`ad-slot`). `share-price` does not, nor does `has-sidebar`; with `alone`, only a
    name of one word can."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in STATES or (alone and len(words) > 1):
        return False
    return words[-1] in BOILER or (words[0] in BOILER and all(w in BOILER or w in PARTS for w in words))


def is_firm(name: str) -> bool:
    return any(w.lower() in FIRM for w in _WORDS.findall(name))


def judged(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """What an element's own markup says of its text, and the name by which it asks.

    Hidden elements, the standard's elements and roles for other parts of a page, and layout whose class or id firmly
    names boilerplate stand outside. Other such names, and forms, ask (see `refused`). On an element that holds text
    itself a name makes the text doubtful only.
    """
    if tag in ASIDE and not (tag == "header" and in_article):
        return OUTSIDE, ""
    if tag in ("html", "body", "main"):
        return FINE, ""
    said, by = (ASKED, "<form>") if tag == "form" else (FINE, "")
    if not _TOLD.search(attributes):
        return said, by
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'") if value[:1] in ("'", '"') else value
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return OUTSIDE, ""
        if name == "role" and value.lower() in ROLES:
            return OUTSIDE, ""
        if name in ("class", "id"):
            for x in value.split():
                if names_boilerplate(x, tag == "article"):
                    if tag in TEXTUAL:
                        said = max(said, DOUBTFUL)
                    elif is_firm(x):
                        return OUTSIDE, ""
                    else:
                        said, by = ASKED, x
    return said, by


def page_lines(page: str) -> list[Line]:
    """Strip markup: one line for each block, in page order; blocks without text are lines too. Linear in the page."""
    lines: list[Line] = []
    stack: list[tuple[str, int, bool, int]] = []  # open elements: name, what is said against it and those around it, whether in the article, the innermost one that asks
    asking: list[Asking] = []
    names: Counter[str] = Counter()  # of open elements that ask
    count: Counter[str] = Counter()  # open elements by name
    endless: set[str] = set()  # elements that nothing closes from here on
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        own = _SPACE.sub(" ", references.unescape("".join(text))).strip()
        lines.append(Line(own, min(linked, len(own)), bool(stack and stack[-1][2]), stack[-1][1] if stack else FINE, stack[-1][3] if stack else -1))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece.strip()) if links else 0

    def opened(tag: str, attributes: str) -> None:
        up = stack[-1] if stack else ("", FINE, False, -1)
        said, by = judged(tag, attributes, up[2])
        asked = up[3]
        if said == ASKED:
            asking.append(Asking(by, up[3], up[2], not names[by]))
            names[by] += 1
            said, asked = FINE, len(asking) - 1
        stack.append((tag, max(up[1], said), up[2] or tag in ("article", "main"), asked))
        count[tag] += 1

    def popped() -> str:
        tag, _, _, asked = stack.pop()
        count[tag] -= 1
        if asked >= 0 and asked != (stack[-1][3] if stack else -1):
            names[asking[asked].name] -= 1
        return tag

    while at < len(page):
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1].replace("&", "&amp;"))
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in OPAQUE and not closing:
            if tag not in VOID and not m[4].endswith("/"):
                end = None if tag in endless else _end_of(tag).search(page, at)
                if end is None:
                    endless.add(tag)
                at = end.end() if end else (len(page) if tag in TO_THE_END else at)
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        if tag in INLINE:
            if tag in VOID:
                continue
            if closing and count[tag]:
                flush()
                while popped() != tag:
                    pass
            elif not closing and (count[tag] or judged(tag, m[4], bool(stack and stack[-1][2]))[0] != FINE):
                flush()
                opened(tag, m[4])
            continue
        flush()
        if closing:
            if count[tag]:
                while popped() != tag:
                    pass
        elif tag not in VOID:
            if tag in ENDS_P or tag in SIBLINGS:
                while stack and stack[-1][0] == "p":
                    popped()
            while stack and stack[-1][0] in SIBLINGS.get(tag, ()):
                popped()
            opened(tag, m[4])
    flush()
    out = refused(asking, lines)
    for x in lines:
        if x.asked >= 0 and out[x.asked]:
            x.said = OUTSIDE
    return lines


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def between_surge_and_dive(lengths: list[int]) -> list[bool]:
    """The line-block distribution: which lines lie between a surge and the next dive.

    A line's block is its own and the next WINDOW - 1 lines; the distribution is the sum of their text lengths. Text
    surges where that sum reaches SURGE, and dives where it falls to DIVE. A surge's lines begin with the first line of
    its block that has a length.
    """
    n = len(lengths)
    sums = [sum(lengths[i : i + WINDOW]) for i in range(n)]
    keep, i = [False] * n, 0
    while i < n:
        if sums[i] < SURGE:
            i += 1
            continue
        while not lengths[i]:
            i += 1
        while i < n and sums[i] > DIVE:
            keep[i] = True
            i += 1
    return keep


def weight(x: Line) -> int:
    """A line's length in the distribution: 0 outside the article and for unmarked lines that are mostly links; at least
    a surge within a marked article, since short paragraphs are article too; doubtful lines must surge by themselves."""
    if x.said == OUTSIDE or not x.text:
        return 0
    if x.said == DOUBTFUL:
        own = int(len(x.text) * DOUBT)
        return own if own >= SURGE else 0
    if x.main:
        return max(len(x.text), SURGE)
    return len(x.text) if 2 * x.linked <= len(x.text) else 0


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, joined by two line feeds.

    Every page goes through the line-block distribution over its lines with text; markup weighs them (see `weight`). What
    lies between a surge and a dive is article, but for lines that stand outside of it; a line of links among its lines
    is article as well, a menu of WINDOW lines is a dive. Where a marked article begins or ends, text dives, so that a
    short line beside it isn't carried along. If marked text outweighs unmarked text that surges, or is as long, the
    latter is another part of the page; if not, the marks are of teasers, and both count. A page without a surge gives
    its lines that nothing is said against.
    """
    if not page:
        return ""
    lines = [x for x in page_lines(page) if x.text]
    order: list[int] = []  # of the distribution's lines; -1 is a blank one
    lengths: list[int] = []
    for i, x in enumerate(lines):
        if i and x.main != lines[i - 1].main:
            order += [-1] * WINDOW
            lengths += [0] * WINDOW
        order.append(i)
        lengths.append(weight(x))
    doubted = [x.said == OUTSIDE or (x.said == DOUBTFUL and not weight(x)) for x in lines]
    found = [i for i, k in zip(order, between_surge_and_dive(lengths), strict=True) if k and i >= 0 and not doubted[i]]
    if not found:
        return "\n\n".join(x.text for x, no in zip(lines, doubted, strict=True) if not no)
    mass = Counter()
    for i in found:
        mass[lines[i].main] += len(lines[i].text)
    return "\n\n".join(lines[i].text for i in found if lines[i].main or mass[False] > mass[True])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages: the whole html in, the article out. One pass, no shuffle.

    Null and empty pages, and pages without text outside of boilerplate, give an empty text and 0; broken markup and a page that ends
    within a tag are read as far as they go; repeated rows are extracted each; null ids and urls stay null; other
    columns are not read, whatever their names; an empty table gives no rows.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = rows.dtypes
    out = rows.mapInArrow(over_arrow(extracted), f"id {kinds[0][1]}, url {kinds[1][1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
