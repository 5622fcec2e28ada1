import random
import time
from html.parser import HTMLParser

import pytest

from papertrail.llm import html as h
from papertrail.llm.html import between_surge_and_dive, judged, main_text, names_boilerplate
from papertrail.llm.queries import op8_html_extraction
from tests.llm.conftest import SF

PAGE = """<!doctype html><html><head><title>T</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body class="page">
<nav><a href=/>Home</a><ul><li>menu</ul></nav><header>Site</header><div id="cookie-banner">We use cookies</div>
%s<aside>related</aside><div class="comments"><p>first!</p></div><form>name <input></form><footer>&copy; foot</footer></body></html>"""
LONG = "This is a sentence of the body which is long enough to make the text surge at this line of the page."


class Slow(HTMLParser):
    """Another reader of well-formed pages: the standard library's tokens, a line's state from all elements around it."""

    def __init__(self):
        super().__init__()
        self.open, self.lines, self.parts, self.links, self.opened = [], [], [], 0, 0

    def flush(self):
        text = " ".join("".join(p for p, _ in self.parts).split())
        linked = min(len(text), sum(len(p.strip()) for p, link in self.parts if link))
        said, main, asks = [], False, []
        for tag, attributes, number in self.open:
            level, name = judged(tag, attributes, main)
            if level == h.ASKED:
                asks.append((number, name, main))
            else:
                said.append(level)
            main = main or tag in ("article", "main")
        self.lines.append(h.Line(text, linked, main, max(said, default=0)))
        self.lines[-1].asked = asks
        self.parts = []

    def settled(self):
        """What an element that asks is granted, from its lines by definition."""
        plain = lambda some: sum(len(x.text) - x.linked for x in some if x.said != h.OUTSIDE)
        all_, within = plain(self.lines), {}
        for x in self.lines:
            for ask in x.asked:
                within.setdefault(ask, []).append(x)
        most = lambda some: plain(some) >= h.SURGE and 2 * plain(some) > all_
        fine = set()
        for ask, own in within.items():
            of_name = [x for x in self.lines if any(a[1] == ask[1] for a in x.asked)]
            linked = sum(x.linked for x in own if x.said != h.OUTSIDE)
            if most(own) or (linked <= plain(own) and (most(of_name) or (ask[2] and plain(own) >= 2 * h.SURGE))):
                fine.add(ask)
        return [h.Line(x.text, x.linked, x.main, h.OUTSIDE if any(a not in fine for a in x.asked) else x.said) for x in self.lines]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append((" ", False))
        if tag in h.VOID:
            return
        if tag in ("p", "ul", "div", "article", "h1") and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")
        if tag not in h.INLINE or judged(tag, self.get_starttag_text(), False)[0]:
            self.flush()
        self.opened += 1
        self.open.append((tag, self.get_starttag_text()[1 + len(tag) : -1], self.opened))

    def handle_endtag(self, tag):
        if tag in h.VOID or tag not in [t for t, *_ in self.open]:
            return
        if tag not in h.INLINE or any(t == tag and judged(t, a, False)[0] for t, a, _ in self.open):
            self.flush()
        while self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(t in h.OPAQUE for t, *_ in self.open):
            self.parts.append((data, any(t == "a" for t, *_ in self.open)))


def slow_text(page):
    """main_text by its definition: a line is article if some block at or before it surges, none between dives, and a
    line with a length lies between them."""
    reader = Slow()
    reader.feed(page)
    reader.close()
    reader.flush()
    lines = [x for x in reader.settled() if x.text]
    grid = []
    for i, x in enumerate(lines):
        grid += [None] * (h.WINDOW * (i > 0 and x.main != lines[i - 1].main)) + [x]
    own = [h.weight(x) if x else 0 for x in grid]
    block = [sum(own[i : i + h.WINDOW]) for i in range(len(grid))]

    def article(i):
        return any(block[s] >= h.SURGE and min(block[s : i + 1]) > h.DIVE and any(own[s : i + 1]) for s in range(i + 1))

    fine = lambda x: x.said == 0 or (x.said == 1 and h.weight(x) > 0)
    found = [x for i, x in enumerate(grid) if x and fine(x) and article(i)]
    marked, other = (sum(len(x.text) for x in found if x.main is side) for side in (True, False))
    return "\n\n".join(x.text for x in (found or lines) if fine(x) and (not found or x.main or other > marked))


def made_page(rng):
    def words(n):
        return " ".join(rng.choice(["alpha", "beta", "über", "x", "&amp;", "<b>bold</b>", "<a href=u>link</a>", "<span class='ad'>buy</span>", "it&#39;s", "<br>"]) for _ in range(n))

    def block(depth):
        tag = rng.choice(["p", "p", "p", "div", "div", "h1", "section", "article", "nav", "aside", "ul"])
        name = rng.choice(["", "", "", " class='share-price'", " class=ad", " id='post-comments'", " class=notice", " class=widget", " id=search-box", " hidden", " role=navigation"])
        inner = words(rng.choice([1, 3, 12, 40, 120])) if tag in ("p", "h1") or depth > 2 else "".join(block(depth + 1) for _ in range(rng.randint(0, 5)))
        return f"<{tag}{name}>{inner}</{tag}>"

    return "<html><head><title>t</title></head><body>" + "".join(block(0) for _ in range(rng.randint(1, 9))) + "</body></html>"


def test_equals_brute_force_on_all_pages_and_on_made_ones(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op8_html_extraction(spark, SF).collect()}
    assert got.keys() == rows.keys()
    for i, page in rows.items():
        assert got[i]["text"] == slow_text(page) and got[i]["n_chars"] == len(got[i]["text"]) > 0
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(bare) == slow_text(bare)
    rng = random.Random(8)
    for _ in range(3000):
        page = made_page(rng)
        assert main_text(page) == slow_text(page), page


def test_pages_without_marks_keep_their_article(spark):
    """The same pages with <div> for <article>: the distribution alone finds the text between menu and footer."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(bare) == main_text(r["html"])


def test_attributes_end_as_the_standard_says():
    assert main_text("<article><p class=it's>Hello there</p><p>Second one, don't drop it.</p></article>") == "Hello there\n\nSecond one, don't drop it."
    assert main_text("<p><a href=x b='>'>t</a> <i title=\"a>b\">u</i></p>") == "t u"
    assert main_text("<p>x<!-->y<!--->z<!-- -- > -->!</p>") == "xyz!"
    assert main_text("a </3 b <3 c") == "a </3 b <3 c"
    assert main_text("<p data-x = 'hidden'>x") == "x" and main_text("<p data-x hidden>x") == ""


def test_names():
    for name in ("ad", "cookie-banner", "ad-slot", "post-comments", "siteHeader", "comment-list", "related_posts", "sidebar2", "adBox"):
        assert names_boilerplate(name), name
    for name in ("share-price", "has-sidebar", "no-ads", "address", "commentary", "post", "searchlight-story", "", "123"):
        assert not names_boilerplate(name), name
    assert main_text("<article><p class='share-price'>up 3</p><p class=notice>gone</p><p>x</p></article>") == "up 3\n\nx"
    long = " ".join([LONG] * 5)
    assert main_text(f"<article><p>a</p><p class=notice>{long}</p></article>") == f"a\n\n{long}"
    assert main_text("<article class='post has-sidebar'><p>a</p></article><article class=comment>b</article>") == "a"


def test_short_lines_between_and_behind_stay():
    links = "<div><a href=1>Read this</a></div><div><a href=2>And that</a></div>"
    assert main_text(PAGE % f"<div><p>{LONG}</p>{links}<p>The end.</p></div>") == f"{LONG}\n\nRead this\n\nAnd that\n\nThe end."
    assert main_text(PAGE % f"{links}<div><p>{LONG}</p><div class=ad>buy</div><p>The end.</p></div>") == f"{LONG}\n\nThe end."


def test_unclosed_elements():
    assert main_text("<article><ul><li class=ad>x<li>y<li>z</ul><table><tr><td hidden>1<td>2<tr><td>3</table></article>") == "y\n\nz\n\n2\n\n3"
    assert main_text("<span class=ad>buy <span>now</span> text</span><p>z</p>") == "z"


def test_distribution():
    assert between_surge_and_dive([0, 0, 100, 5, 0, 0, 0, 90, 0]) == [False, False, True, True, False, False, False, True, False]
    assert between_surge_and_dive([80, 0, 0, 6, 0, 0, 0, 6]) == [False] * 8
    assert between_surge_and_dive([80, 0, 0, 6, 80, 0, 6]) == [False, False, False, True, True, True, True]
    assert between_surge_and_dive([]) == []


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x" + "</div>" * 60_000, "<div>" * 60_000 + "</p>" * 60_000, "<a b='" * 60_000, "<button>" * 60_000, "<" * 60_000, "<span class=ad>" * 60_000, "<ul><li>" * 60_000, "<a " + "b " * 60_000, "<!--" * 60_000, "</" * 60_000])
def test_linear(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 3


ONE, TWO = ("The river rose " + "slowly and surely all through the wet night " * 5).strip() + ".", ("By morning the old bridge " + "stood under water and nobody could cross " * 5).strip() + "."
BOTH = f"{ONE}\n\n{TWO}"


@pytest.mark.parametrize("name", ["elementor-widget elementor-widget-text-editor", "text-widget", "layout sidebar", "page search", "story-related", "legal-text", "social-text", "post-alert", "product-promo"])
def test_no_name_loses_the_article(name):
    """Hand-made truth: two paragraphs, whatever the layout around them is called; with a menu, a real box, a comment."""
    extra = "<div class=sidebar><a href=1>one</a> <a href=2>two</a></div><div class='cookie-notice'>We use cookies, as all do.</div><div class=comments><p>" + "I liked this very much. " * 60 + "</p></div>"
    whole, each = f"<div class='{name}'><p>{ONE}</p><p>{TWO}</p></div>", "".join(f"<div class='{name}'><p>{x}</p></div>" for x in (ONE, TWO))
    for body in (whole, each):
        assert main_text(f"<html><body>{body}</body></html>") == BOTH
        assert main_text(f"<html><body><nav><a href=/>Home</a></nav>{body}{extra}<footer>foot</footer></body></html>") == BOTH
        assert main_text(f"<html><body><article>{body}</article>{extra}</body></html>") == BOTH


def test_a_form_around_the_page():
    assert main_text(f"<body><form action=/page.aspx><div id=menu><a href=1>x</a></div><p>{ONE}</p><p>{TWO}</p><input></form></body>") == BOTH
    assert main_text(f"<body><p>{ONE}</p><p>{TWO}</p><form>Your name <input> Your mail <input> " + "Send us what you think of it. " * 4 + "</form></body>") == BOTH


def test_names_within_an_article():
    assert main_text(f"<article><section id=search><h2>Search</h2><p>{ONE}</p></section><section id=copyright><p>{TWO}</p></section></article>") == f"Search\n\n{BOTH}"
    assert main_text(f"<article><p>{ONE}</p><div class=related><a href=1>{LONG}</a><a href=2>{LONG}</a></div><p>{TWO}</p><ol class=commentlist><li>{LONG}<li>{LONG}</ol></article>") == BOTH
    assert main_text(f"<article><p>{ONE}</p><div class=promo>Buy now!</div><p>{TWO}</p></article>") == BOTH


def test_article_alone_outweighs_what_is_beside_it():
    article = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    assert main_text(PAGE % f"<div>{LONG}</div>{article}") == f"{LONG}\n\n{LONG}"
