"""Texts in pieces for models: WordPiece tokens, chunks with overlap, masks for images."""

from __future__ import annotations

import unicodedata
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, OVERLAP, HEADER, SLICE = 110, 20, 120, 400
LONGEST_WORD, ENCODED = 100, 128
#: Words whose number of pieces a worker remembers.
REMEMBERED = 200_000


def _cjk(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0x20000 <= n <= 0x2FA1F or 0xF900 <= n <= 0xFAFF


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P" or (c.isascii() and not c.isalnum() and c.isprintable() and c != " ")


def basic_tokens(text: str) -> list[str]:
    """Words as uncased models split them: lower case without accents, ideographs and punctuation alone."""
    out = []
    for c in unicodedata.normalize("NFD", text.lower()):
        kind = unicodedata.category(c)
        if kind == "Mn" or c in "\0�" or (kind in ("Cc", "Cf") and c not in "\t\n\r"):
            continue
        out.append(f" {c} " if _cjk(c) or _punctuation(c) else " " if c.isspace() else c)
    return "".join(out).split()


class WordPiece:
    """Greedy longest-match pieces of a given vocabulary (token to id)."""

    def __init__(self, vocabulary: dict[str, int], unknown: str = "[UNK]", start: str = "[CLS]", end: str = "[SEP]") -> None:
        self.vocabulary, self.unknown, self.start, self.end = vocabulary, unknown, start, end
        self.heads = {t for t in vocabulary if not t.startswith("##")}
        self.tails = {t[2:] for t in vocabulary if t.startswith("##")}
        self.longest = [max(map(len, x), default=0) for x in (self.heads, self.tails)]
        self.counts: dict[str, int] = {}

    def pieces(self, word: str) -> list[str]:
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        out, at = [], 0
        while at < len(word):
            known, most = (self.tails, self.longest[1]) if at else (self.heads, self.longest[0])
            end = next((e for e in range(min(len(word), at + most), at, -1) if word[at:e] in known), None)
            if end is None:
                return [self.unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    def tokens(self, text: str) -> list[str]:
        return [p for w in basic_tokens(text) for p in self.pieces(w)]

    def encode(self, text: str, size: int = ENCODED) -> list[int]:
        """Ids between start and end, cut to size."""
        return [self.vocabulary[t] for t in (self.start, *self.tokens(text)[: size - 2], self.end)]

    def count(self, text: str) -> int:
        """How many pieces a text has; short ones are remembered, so that a corpus's words are each cut up once."""
        n = self.counts.get(text)
        if n is None:
            n = len(self.tokens(text))
            if len(text) <= LONGEST_WORD:
                if len(self.counts) >= REMEMBERED:
                    self.counts.clear()
                self.counts[text] = n
        return n


_worker: list[tuple[str, WordPiece]] = []


def _model(key: str, vocabulary: Callable[[], dict[str, int]]) -> WordPiece:
    """One for each Python worker, which its next tasks go on with."""
    if not _worker or _worker[0][0] != key:
        _worker[:] = [(key, WordPiece(vocabulary()))]
    return _worker[0][1]


def chunk(text: str, count: Callable[[str], int], most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """(chunk, pieces): whole words up to `most` pieces; the next one steps back over up to `overlap`, but always goes on.

    Borders are looked up in the sums of the words' pieces: where a chunk ends, and how far the next one reaches back.
    """
    words = text.split()
    sums = [0, *accumulate(map(count, words))]
    out, start = [], 0
    while start < len(words):
        end = max(start + 1, bisect_right(sums, sums[start] + most) - 1)
        if sums[end] > sums[start]:
            out.append((" ".join(words[start:end]), sums[end] - sums[start]))
        if end == len(words):
            break
        start = max(start + 1, bisect_left(sums, sums[end] - overlap, 0, end))
    return out


def fit(text: str, budget: int, count: Callable[[str], int]) -> str:
    """The longest beginning of whole words within a budget of pieces."""
    out = []
    for w in text.split():
        budget -= count(w)
        if budget < 0:
            break
        out.append(w)
    return " ".join(out)


def document_chunks(docs: DataFrame, *, text: str = "text", facts: str | None = None, label: str | None = None, vocabulary: dict[str, int] | None = None) -> DataFrame:
    """(id, chunk_ix, text, pieces): chunk 0 is the facts line if there is one, then the text's chunks, behind the label.

    The vocabulary goes to each executor once, and each of its workers makes one model of it. Without a vocabulary a word
    is a piece where facts are fitted, and the text falls into slices of 400 characters.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, lambda: sent.value) if sent.value else None
        count = model.count if model else lambda w: 1
        for b in batches:
            out = []
            for i, t, f, name in zip(b["id"], b["t"], b["f"], b["l"], strict=True):
                t = t or ""
                own = [(fit(f, HEADER, count), -1)] if f else []
                if model:
                    own += chunk(t, count)
                else:
                    own += [(t[k : k + SLICE], -1) for k in range(0, len(t), SLICE)]
                for k, (c, n) in enumerate(own):
                    c = f"{name}. {c}" if name and k >= 1 else c
                    out.append((i, k, c, count(c) if n < 0 and model else len(c.split()) if n < 0 else n))
            yield pd.DataFrame(out, columns=["id", "chunk_ix", "text", "pieces"])

    none = F.lit(None).cast("string")
    chosen = docs.select("id", F.col(text).alias("t"), (F.col(facts) if facts else none).alias("f"), (F.col(label) if label else none).alias("l"))
    return chosen.mapInPandas(rows, "id long, chunk_ix int, text string, pieces int")
