import math
import time
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.llm import lattice
from papertrail.llm.html import between_surge_and_dive, extract, main_text
from papertrail.llm.queries import op7_lm_score, op8_html_extraction
from papertrail.llm.tokens import vocabulary_path
from tests.llm.conftest import ROWS, SF


def segmentations(word, pieces, logp):
    """The probability of a word as a sum over all ways to cut it."""
    p = dict(zip(pieces, np.exp(logp), strict=True))

    def ways(rest):
        return 1.0 if not rest else sum(p[rest[:k]] * ways(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in p)

    return ways(b" " + word)


def test_forward_sums_all_segmentations():
    pieces, logp = lattice.vocabulary_pieces(vocabulary_path("piece_bpe_32k.model"))
    model = lattice.Pieces(pieces)
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    words = [b"the", b"nation", "été".encode(), b"x", b"*&^%", b"thing,"]
    got = model.forward(words, logp)
    for w, x in zip(words, got, strict=True):
        assert math.isclose(x, math.log(segmentations(w, model.pieces, logp)), rel_tol=1e-9)


def test_expected_counts():
    model = lattice.Pieces([b" a", b"ab", b" ab"])
    p = np.full(len(model.pieces), 1e-4)
    at = {x: i for i, x in enumerate(model.pieces)}
    p[at[b" a"]], p[at[b"b"]], p[at[b" ab"]] = 0.1, 0.2, 0.03
    ways = {(b" ab",): 0.03, (b" a", b"b"): 0.02, (b" ", b"ab"): 1e-8, (b" ", b"a", b"b"): 1e-4 * 1e-4 * 0.2}
    got = model.expected([b"ab"], np.log(p))
    for x in (b" ab", b" a", b"b", b" "):
        want = sum(v for k, v in ways.items() if x in k) / sum(ways.values())
        assert math.isclose(got[at[x]], want, rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_base_scores_equal_brute_force(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts, ends = Counter(), 0
    for d, w in texts.items():
        if not held[d]:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    rows = op7_lm_score(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = texts[r["doc_id"]]
        cs = [*(counts[x] for x in w), ends]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(cs), sum(c > 0 for c in cs), n)
        assert math.isclose(r["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in cs), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def slow_score(word, p, longest):
    """log10 of a word's probability over all cuts into pieces, by the plain recursion over its bytes."""
    word = b" " + word
    alpha = [Decimal(1)] + [Decimal(0)] * len(word)
    for j in range(1, len(word) + 1):
        alpha[j] = sum(alpha[i] * p[word[i:j]] for i in range(max(0, j - longest), j) if word[i:j] in p)
    return float(alpha[-1].log10())


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_whole_scores_equal_brute_force(spark, docs, monkeypatch, frequent):
    """score, once more in plain Python: expectation maximisation over the training words, then all documents' words."""
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    extra = [(10**6, "x" * 70 + " seen " + "é" * 150), (10**6 + 1, "http://" + "ab1" * 300 + " " + "日本語" * 40 + " the")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in df.collect()}
    learned = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d in texts}
    counts, ends = Counter(), sum(learned.values())
    for d, w in texts.items():
        counts.update(w if learned[d] else [])
    n, v = sum(counts.values()) + ends, len(counts) + 1
    pieces, logp = lattice.vocabulary_pieces(vocabulary_path("piece_bpe_32k.model"))
    model = lattice.Pieces(pieces)
    for _ in range(lattice.STEPS):  # expected() is held against all segmentations above
        total = model.expected(list(counts), logp) + 1e-3
        logp = np.log(total / total.sum())
    p = {x: Decimal(y) for x, y in zip(model.pieces, np.exp(logp).tolist(), strict=True)}
    rest = math.log10(v / (n + v))
    memo = {w: slow_score(w, p, model.longest) for w in set().union(*texts.values())}

    def score(w):
        s = memo[w] + rest
        return s if w not in counts else max(s, math.log10(counts[w] / (n + v))) + math.log10(1 + 10 ** -abs(s - math.log10(counts[w] / (n + v))))

    rows = lattice.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = sum(map(score, texts[r["doc_id"]])) + math.log10(ends / (n + v))
        assert math.isclose(r["score"], want, rel_tol=1e-6), r


def test_words_without_end_are_linear():
    pieces, logp = lattice.vocabulary_pieces(vocabulary_path("piece_bpe_32k.model"))
    model = lattice.Pieces(pieces)
    rng = np.random.default_rng(1)
    blob = bytes(rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 1 << 20))
    start = time.process_time()
    one, han = model.forward([blob, ("我们一起学习中文" * 12_000).encode()], logp)
    model.expected([blob], logp)
    assert time.process_time() - start < 30 and -1e8 < one < -1e6 and -1e8 < han < -1e5


def test_long_words_are_not_cut():
    """A thousand times the same letter, and a word at the border between the two ways of handling words."""
    pieces, _ = lattice.vocabulary_pieces(vocabulary_path("piece_bpe_32k.model"))
    model = lattice.Pieces([b"x", b"xx", b"xxx", b" x", b"x" * 16])
    logp = np.log(np.full(len(model.pieces), 1 / len(model.pieces)))
    p = {x: Decimal(1) / len(model.pieces) for x in model.pieces}
    for n in (lattice.LONG - 1, lattice.LONG, lattice.LONG + 1, 1000, 70_000):
        got = model.forward([b"x" * n], logp)[0] / math.log(10)
        assert math.isclose(got, slow_score(b"x" * n, p, 16), rel_tol=1e-9), n
    counts = model.expected([b"x" * 300], logp)
    assert math.isclose(sum(c * len(x) for c, x in zip(counts, model.pieces, strict=True)), 301, rel_tol=1e-6)
    short = model.expected([b"x" * 200], logp)
    out = np.zeros(len(model.pieces))
    model._expect_long(b" " + b"x" * 200, logp.tolist(), out)
    assert np.allclose(short, out) and len(pieces) > 10_000


def test_scores_of_odd_documents(odd, none):
    got = lattice.score(odd, F.col("doc_id") < 3).collect()
    assert len(got) == len(ROWS) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[6]["n_tokens"] == 60_001
    assert by[1]["train_tokens"] == 3 * 14 and by[1]["n_known"] == 14
    nothing = lattice.score(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in nothing)
    assert lattice.score(none, F.lit(True)).count() == 0


def test_long_unseen_words_cost_their_spelling(spark):
    rng = np.random.default_rng(6)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 3000))
    rows = [(0, "a few words to learn from"), (1, "words"), (2, "words " + long), (3, "words " + long + " " + long[::-1])]
    got = {r["doc_id"]: r["score"] for r in lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") == 0).collect()}
    assert got[2] < got[1] - 1000 and got[3] < got[2] - 1000


PAGE = """<!doctype html><html><head><title>T</title><script>var x="<p>no</p>";</script><style>p{}</style></head><body class="page">
<nav><a href=/>Home</a><ul><li>menu</ul></nav><header>Site</header><div id="cookie-banner">We use cookies</div>
%s<aside>related</aside><div class="comments"><p>first!</p></div><form>name <input></form><footer>&copy; foot</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>One <b>bold</b>\n  word&nbsp;here<br>next<p>short<!-- no --><ul><li>item one<li>item two</ul><pre>a\n b</pre><p hidden>gone</p>"
TEXT = "A & B\n\nOne bold word here next\n\nshort\n\nitem one\n\nitem two\n\na b"


def test_article():
    assert main_text(PAGE % f"<article>{BODY}<div class=ad>buy</div></article>") == TEXT
    assert main_text(PAGE % f"<main><article>{BODY}") == TEXT


def test_line_block_distribution():
    long = "This is a sentence of the article which is long enough to make the text surge at this line of the page."
    assert main_text(PAGE % f"<div><a href=x>link</a></div><div><p>{long}</p><p>short</p><p>{long}</p></div>") == f"{long}\n\nshort\n\n{long}"
    assert main_text("plain words") == "plain words"


def test_distribution_runs_on_marked_pages():
    long = "This is a sentence of the body which is long enough to make the text surge at this line of the page."
    teasers = "<article><a href=1>One</a></article><article><a href=2>Two</a></article>"
    assert main_text(PAGE % f"{teasers}<div><p>{long}</p><p>short</p><p>{long}</p></div>") == f"One\n\nTwo\n\n{long}\n\nshort\n\n{long}"
    assert main_text(PAGE % f"<p>by me</p><article>{BODY}</article><p>end</p>") == TEXT
    assert between_surge_and_dive([0, 0, 0, 100, 5, 0, 0, 0, 90, 0]) == [False, False, False, True, True, False, False, False, True, False]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>a</p", "<<>>", "<script>x", "<!-- x", "</p></p>", "<p a='", "&amp", "<article>", "<div><nav>"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_pages(spark):
    got = op8_html_extraction(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) and "<" not in r["text"].replace("<|", "") for r in got) and sum(r["n_chars"] > 0 for r in got) == len(got)
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x", None), (2, "v", "<p>" + "y " * 200_000, 1)]
    df = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long"))
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in df.collect()) == [("1", 0), ("1", 0), ("2", 399_999), ("None", 1)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
