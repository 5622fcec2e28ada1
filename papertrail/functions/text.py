"""Text functions: folding, normal forms, tokens, scripts, edit distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Digits that are folded to ASCII, and the stop words of search queries.
_FOREIGN_DIGITS = "०१२३४५६७८९౦౧౨౩౪౫౬౭౮౯０１２３４５６７８９"
_ASCII_DIGITS = "0123456789" * 3
STOP_WORDS = "a an and any are as at be by can could did do does for from get give had has have he her him his how i in is it its just like list look me my of on or our out please show she some that the their them there these they this to us was we were what when where which who whom whose why will with would you your want need find see tell all also am been but into more not one only over than then too up very".split()
FOLD = str.maketrans(_FOREIGN_DIGITS, _ASCII_DIGITS)
#: Letters, marks and numbers make words; everything else parts them.
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def fold_digits(text: Column) -> Column:
    """Devanagari, Telugu and full-width digits as ASCII; every position stays."""
    return F.translate(text, _FOREIGN_DIGITS, _ASCII_DIGITS)


def fold_digits_np(points: np.ndarray) -> np.ndarray:
    """fold_digits of code points."""
    for zero in _FOREIGN_DIGITS[::10]:
        digit = points - np.uint32(ord(zero))
        points = np.where(digit < 10, digit + np.uint32(ord("0")), points)
    return points


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition. Text without combining or compatibility characters never leaves the JVM's row."""
    return F.when(text.rlike(r"[^\u0000-˿]"), _nfc(F.when(text.rlike(r"[^\u0000-˿]"), text))).otherwise(text)


def normalize_query_text(s: str) -> str:
    """Digits folded, NFC, lower case, joiners dropped, punctuation and symbols (but @) as blanks, blanks collapsed."""
    t = unicodedata.normalize("NFC", s.translate(FOLD)).lower()
    out = []
    for c in t:
        if c in "‌‍":
            continue
        astral = ord(c) > 0xFFFF  # handled as UTF-16 units by contract: not symbols
        out.append(" " if c != "@" and not astral and unicodedata.category(c)[0] in "PS" else c)
    return " ".join("".join(out).split())


@F.pandas_udf(StringType())
def normalize_query(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else normalize_query_text(x))


def words(text: Column) -> Column:
    """Lower-case words of more than one character."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: F.length(w) > 1)


def word_set(text: Column) -> Column:
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets: shared by all; 1 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def query_terms(text: Column, most: int = 16) -> Column:
    """Search terms of a query: words of two characters or more, no stop words, the first 16 distinct ones."""
    own = F.filter(F.split(F.lower(fold_digits(text)), SEPARATORS), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))
    return F.slice(F.array_distinct(own), 1, most)


#: The scripts that are told apart.
SCRIPTS = {"latin": "Latin", "devanagari": "Devanagari", "telugu": "Telugu", "tamil": "Tamil", "kannada": "Kannada"}


def scripts(text: Column) -> Column:
    """Scripts with at least 3 letters and 5 % of all letters, by name."""
    n = {name: F.length(F.regexp_replace(text, rf"\P{{Is{script}}}", "")) for name, script in SCRIPTS.items()}
    total = F.length(F.regexp_replace(text, r"\P{L}", ""))
    return F.array_compact(F.array(*(F.when((c >= 3) & (c * 20 >= total), F.lit(name)) for name, c in n.items())))


def useful_chars(text: Column) -> Column:
    """Letters and digits: a text with fewer than 40 is no document."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def osa_distance(a: str, b: str, cap: int) -> int:
    """Edits that make b of a, neighbours swapped counting one; cap + 1 as soon as there are more than cap."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > cap:
            return cap + 1
        before, last = last, row
    return last[-1]


def damerau_distance(a: str, b: str, cap: int) -> int:
    """As osa_distance, but what stands between swapped neighbours may have been edited too: `ca` and `abc` are two apart."""
    if abs(len(a) - len(b)) > cap:
        return cap + 1
    most, seen = len(a) + len(b), dict.fromkeys(b, 0)
    d = [[most] * (len(b) + 2), [most, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, same = [most, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen[y], same  # the last places before these at which the other's letter stands
            best = min(d[i][j] + (x != y), d[i][j + 1] + 1, row[j] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
            if x == y:
                same = j
            row.append(best)
        d.append(row)
        if x in seen:
            seen[x] = i
    return min(d[-1][-1], cap + 1)


def _distances(of: Callable[[str, str, int], int], cap: int):  # noqa: ANN202
    @F.pandas_udf(IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else of(x, y, cap) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance


def osa(cap: int):  # noqa: ANN201
    """A column function of two strings: their capped edit distance."""
    return _distances(osa_distance, cap)


def damerau(cap: int):  # noqa: ANN201
    """A column function of two strings: their capped edit distance, also between swapped neighbours."""
    return _distances(damerau_distance, cap)


def first_json_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, braces within strings not counting; null if there is none."""
    if text is None:
        return None
    start = text.find("{")
    depth, quoted, i = 0, False, start
    while 0 <= i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


@F.pandas_udf(StringType())
def first_json(s: pd.Series) -> pd.Series:
    return s.map(first_json_object)


def tidy_reply(text: Column, speaker: str = "Assistant") -> Column:
    """A reply without its speaker's prefix and the quotes around it."""
    body = F.trim(F.regexp_replace(F.trim(text), f"^{speaker}:", ""))
    return F.trim(F.when(body.rlike(r'^"[\s\S]*"$') & (F.length(body) > 1), F.substring(body, F.lit(2), F.length(body) - 2)).otherwise(body))


def matches(text: Column, pattern: str) -> Column:
    """Every match of a pattern, as an array of (start, m): its place (from 0) and the text matched."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    empty = F.struct(F.array().cast("array<struct<start:int,m:string>>").alias("done"), F.lit(0).alias("at"))

    def onward(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["before"])
        here = F.struct(start.alias("start"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), a).otherwise(F.struct(F.array_append(a["done"], here).alias("done"), (start + F.length(x["m"])).alias("at")))

    return F.aggregate(found, empty, onward, lambda a: a["done"])
