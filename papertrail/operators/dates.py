"""Dates in lines of text: found, read, and picked as expiry or issue date."""

from __future__ import annotations

import calendar
import datetime as dt
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.functions.text import FOLD, fold_digits, nfc
from papertrail.storage import stored

# Names of the months in English, Hindi and Telugu.
MONTHS: dict[int, list[str]] = {
    1: ["january", "jan", "जनवरी", "జనవరి"],
    2: ["february", "feb", "फ़रवरी", "फरवरी", "ఫిబ్రవరి"],
    3: ["march", "mar", "मार्च", "మార్చి"],
    4: ["april", "apr", "अप्रैल", "अप्रेल", "ఏప్రిల్"],
    5: ["may", "मई", "మే"],
    6: ["june", "jun", "जून", "జూన్"],
    7: ["july", "jul", "जुलाई", "జూలై", "జులై"],
    8: ["august", "aug", "अगस्त", "ఆగస్టు", "ఆగష్టు", "ఆగస్ట్"],
    9: ["september", "sept", "sep", "सितंबर", "सितम्बर", "సెప్టెంబర్", "సెప్టెంబరు"],
    10: ["october", "oct", "अक्टूबर", "अक्तूबर", "అక్టోబర్", "అక్టోబరు"],
    11: ["november", "nov", "नवंबर", "नवम्बर", "నవంబర్", "నవంబరు"],
    12: ["december", "dec", "दिसंबर", "दिसम्बर", "డిసెంబర్", "డిసెంబరు"],
}
MONTH_OF = {unicodedata.normalize("NFC", name).lower(): m for m, names in MONTHS.items() for name in names}
_NAMES = "|".join(sorted(map(re.escape, MONTH_OF), key=len, reverse=True))
#: A name may not go on with a letter or a mark; Python has no class for marks, so those of the two scripts are named.
_GOES_ON = r"(?![^\W\d_]|[̀-ͯऀ-ःऺ-ॏఀ-ఃా-్])"
_BEGINS = r"(?<![^\W\d_])"
_GAP = r"[\s\-/.,]"
_ALONE = r"(?<![\d/.\-])"
_ENDS = r"(?![\d/.\-]*\d)"
# How dates are written, in order of preference.
_SHAPES = [
    re.compile(rf"(?<!\d)(?P<d>\d{{1,2}})(?:st|nd|rd|th)?{_GAP}*(?P<m>{_NAMES})\.?{_GOES_ON}[\s\-/.,']*(?P<y>\d{{4}}|\d{{2}})(?!\d)", re.I),
    re.compile(rf"{_BEGINS}(?P<m>{_NAMES})\.?{_GOES_ON}{_GAP}*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?{_GAP}+(?P<y>\d{{4}})(?!\d)", re.I),
    re.compile(rf"{_ALONE}(?P<a>\d{{1,2}})(?P<s>[/.\-])(?P<b>\d{{1,2}})(?P=s)(?P<y>\d{{4}}|\d{{2}}){_ENDS}"),
    re.compile(rf"{_ALONE}(?P<y>\d{{4}})(?P<s>[/.\-])(?P<m>\d{{1,2}})(?P=s)(?P<d>\d{{1,2}}){_ENDS}"),
    re.compile(rf"{_BEGINS}(?P<m>{_NAMES})\.?{_GOES_ON}{_GAP}*(?P<y>\d{{4}}|'\d{{2}})(?!\d)", re.I),
    re.compile(rf"{_ALONE}(?P<m>0?[1-9]|1[0-2])[/\-](?P<y>\d{{4}}){_ENDS}"),
]


class Found(NamedTuple):
    date: dt.date
    precision: str
    line: int
    start: int
    end: int
    raw: str
    ambiguous: bool
    month_first: bool

    @property
    def last_day(self) -> dt.date:
        return month_end(self.date) if self.precision == "month" else self.date


def month_end(day: dt.date) -> dt.date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])


def full_year(y: int, today: dt.date) -> int:
    """Two digits: up to thirty years ahead belong to this century, others to the last."""
    return y if y >= 100 else (2000 if y <= today.year % 100 + 30 else 1900) + y


def plain_line(line: str) -> str:
    return unicodedata.normalize("NFC", line.translate(FOLD))


def _read(shape: int, m: re.Match, today: dt.date) -> tuple[dt.date, str, bool, bool] | None:
    g = m.groupdict()
    year = full_year(int(g["y"].lstrip("'")), today)
    ambiguous = month_first = False
    if shape == 2:
        a, b = int(g["a"]), int(g["b"])
        month_first = b > 12
        day, month = (b, a) if month_first else (a, b)
        ambiguous = not month_first and a <= 12 and a != b
    else:
        month = int(g["m"]) if g["m"].isdigit() else MONTH_OF.get(unicodedata.normalize("NFC", g["m"]).lower(), 0)
        day = int(g.get("d") or 1)
    try:
        found = dt.date(year, month, day)
    except ValueError:
        return None
    return (found, "month" if shape >= 4 else "day", ambiguous, month_first) if 1900 <= year <= 2100 else None


def dates_in(line: str, number: int, today: dt.date) -> list[Found]:
    """Dates of a line, day before month unless that can't be. Of overlapping readings the longest wins, then the order of shapes."""
    t = plain_line(line)
    if not any(c.isdigit() for c in t):
        return []
    hits = []
    for shape, pattern in enumerate(_SHAPES):
        for m in pattern.finditer(t):
            got = _read(shape, m, today)
            if got:
                hits.append((m.start() - m.end(), shape, m.start(), Found(got[0], got[1], number, m.start(), m.end(), m[0], got[2], got[3])))
    kept: list[Found] = []
    for *_, f in sorted(hits, key=lambda h: h[:3]):
        if all(f.end <= k.start or k.end <= f.start for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f.start)


# Words that mark an expiry date, words that mark another date, and words between the ends of a period.
_EXPIRY = "|".join([r"valid\s*(?:till|upto|up\s*to|until|thru|through)", "validity", "expir(?:y|es|ing|ation|ed)", r"(?<![a-z])exp(?:\.|(?![a-z]))", r"due\s*date", r"pay(?:able)?\s*by", r"last\s*date", "renew(?:al)?", r"(?:policy|cover|coverage)\s*(?:end|expiry)", r"end\s*date", "समाप्ति", "वैधता", r"तक\s*(?:वैध|मान्य)", "नवीनीकरण", r"देय\s*तिथि", r"अंतिम\s*तिथि", "గడువు", "చెల్లుబాటు", "పునరుద్ధరణ", "ముగింపు", r"చివరి\s*తేదీ"])
_NOT_EXPIRY = "|".join([r"date\s*of\s*birth", "(?<![a-z])dob(?![a-z])", "birth", "issue(?:d)?", r"valid\s*from", "(?<![a-z])from(?![a-z])", r"start\s*date", "commencement", "inception", r"(?:bill|invoice|statement|print(?:ed)?|generated)\s*(?:date|on)", r"date\s*of\s*(?:admission|discharge|registration|reg)", "जन्म", "जारी", "प्रारंभ", "పుట్టిన", "జారీ", "ప్రారంభ"])
_CONNECTS = r"\s*(?:to|till|until|upto|up\s*to|[-–—~]|से|నుండి|నుంచి)\s*"
_PERIOD = "period|valid|cover|insurance|policy|tenure|term|अवधि|मान्य|बीमा|కాలం|కాలపరిమితి|చెల్లుబాటు|బీమా"
_ISSUE = r"issue|issued|dated|date of issue|bill date|invoice date|statement date|report date|pay\s*period|for the month|salary for|month of|payslip for|pay slip for|statement period|generated on|जारी|दिनांक|माह|తేదీ|నెల"


def _says(line: Column, words: str) -> Column:
    return line.rlike(f"(?iU)(?:{words})")


def _end_of_last(line: Column, words: str) -> Column:
    """Where the last of some words in a line ends; 0 if there is none."""
    return F.length(F.regexp_extract(line, f"(?iUs)^.*(?:{words})", 0))


DATES = "id long, line int, start int, end int, date date, precision string, last_day date, raw string, ambiguous boolean, month_first boolean"
#: Documents without a digit are not looked into.
_DIGIT = "[0-9०-९౦-౯０-９]"
MOST_CANDIDATES = 8


def lines_of(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(id, line, plain): the lines, counted from 0, of documents that have a digit: digits folded, characters composed."""
    rows = docs.select("id", F.col(text).alias("t")).filter(F.col("t").rlike(_DIGIT))
    rows = rows.select("id", F.posexplode(F.split("t", "\n", -1)).alias("line", "own"))
    return rows.select("id", "line", nfc(fold_digits(F.col("own"))).alias("plain"))


def _read_lines(lines: DataFrame, today: dt.date) -> DataFrame:
    """A row for every date in lines (id, line, plain). Lines without a digit don't leave the JVM."""
    names = [x.split()[0] for x in DATES.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, f) for i, n, t in zip(b["id"], b["line"], b["plain"], strict=True) for f in dates_in(t, int(n), today)]
            yield pd.DataFrame([(i, f.line, f.start, f.end, f.date, f.precision, f.last_day, f.raw, f.ambiguous, f.month_first) for i, f in found], columns=names)

    return lines.filter(F.col("plain").rlike("[0-9]")).mapInPandas(rows, DATES)


def extract(docs: DataFrame, today: dt.date, *, text: str = "text") -> DataFrame:
    """A row for every date in a document's lines."""
    return _read_lines(lines_of(docs, text=text), today)


def judged(docs: DataFrame, today: dt.date, *, text: str = "text") -> DataFrame:
    """extract() with what words say of each date: doc_type, marked (as an expiry date; if not as one, false), issue (as an
    issue date).

    Words before a date on its line decide, the nearest first, unless they stand before another date. If there are none,
    a line above or below that has no date decides. Two days that words of a period join, the second the later one, are
    its ends: the first is no expiry date, the second is. Where no expiry is expected of a type, a period also needs a
    word that says so, on its line or the one above.
    """
    lines = stored(lines_of(docs, text=text), "lines")
    found = stored(_read_lines(lines, today), "dates")
    dated = found.select("id", "line").distinct().withColumn("has_date", F.lit(True))
    plain, order = F.col("plain"), Window.partitionBy("id").orderBy("line")
    told = lines.join(dated, ["id", "line"], "left").select(
        "id", "line", "has_date",
        F.when(F.col("has_date"), plain).alias("plain"),
        (_says(plain, _EXPIRY) & ~_says(plain, _NOT_EXPIRY) & F.col("has_date").isNull()).alias("lends_expiry"),
        (_says(plain, _ISSUE) & F.col("has_date").isNull()).alias("lends_issue"),
        _says(plain, _PERIOD).alias("period"),
    )
    near = lambda c, n: F.coalesce(F.lag(c, n).over(order), F.lit(False))
    told = told.select("id", "line", "has_date", "plain", (near("lends_expiry", 1) | near("lends_expiry", -1)).alias("expiry_beside"), near("lends_issue", 1).alias("issue_above"), (F.col("period") | near("period", 1)).alias("period"))
    rows = found.join(told.filter("has_date").drop("has_date"), ["id", "line"])
    rows = rows.join(docs.select("id", "doc_type"), "id")
    on_line = Window.partitionBy("id", "line").orderBy("start")
    before = F.substring("plain", F.lit(1), F.col("start"))
    yes, no = _end_of_last(before, _EXPIRY), _end_of_last(before, _NOT_EXPIRY)
    earlier = F.coalesce(F.lag("end").over(on_line), F.lit(0))
    by_words = F.when((yes > 0) | (no > 0), (yes > no) & (yes > earlier)).otherwise(F.col("expiry_beside"))
    rows = rows.withColumns({"by_words": by_words, "issue": _says(before, _ISSUE) | F.col("issue_above")})
    # periods: of days only, each with the next one on its line
    day = F.col("precision") == "day"
    days = Window.partitionBy("id", "line", "precision").orderBy("start")
    between = F.substring("plain", F.col("end") + 1, F.lead("start").over(days) - F.col("end"))
    joins = day & (F.lead("date").over(days) > F.col("date")) & between.rlike(f"(?iU)^(?:{_CONNECTS})$")
    expires = F.col("doc_type").isin([t.name for t in dims.DOC_TYPES if t.expires])
    rows = rows.withColumn("opens", F.coalesce(joins & (F.coalesce(expires, F.lit(False)) | F.col("period")), F.lit(False)))
    closes = day & F.coalesce(F.lag("opens").over(days), F.lit(False))
    rows = rows.withColumn("marked", F.when(F.col("opens"), False).when(closes, True).otherwise(F.col("by_words")))
    return rows.select(*(x.split()[0] for x in DATES.split(", ")), "doc_type", "marked", "issue")


def pick(docs: DataFrame, today: dt.date, *, text: str = "text") -> DataFrame:
    """(id, expiry_on, expiry_source, candidates, issued_on) for every document (id, doc_type, text).

    The one day that words or a period mark is the expiry date (source rule). Of several, candidates for a model or a
    person, the first that is still to come serves meanwhile, else the last one (source fallback). A type that expires
    and has no marked day has up to eight candidates. Types that don't expire have none; unknown ones need marked days.

    The issue date is the latest day that words of issue mark, else, of monthly types, the latest month, else the latest
    day; never one to come, nor the expiry date.
    """
    rows = stored(judged(docs, today, text=text), "judged")
    now, kind = F.lit(today), F.col("doc_type")
    expires = kind.isin([t.name for t in dims.DOC_TYPES if t.expires])
    may = F.coalesce(expires, F.lit(False)) | kind.isNull() | (kind == dims.OTHER)
    place = F.struct("line", "start")
    each = rows.filter(may).groupBy("id", "doc_type", "last_day").agg(F.max("marked").alias("marked"), F.min(F.when(F.col("marked"), place)).alias("marked_at"), F.min(place).alias("at"))
    per_doc = each.groupBy("id", "doc_type").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("marked"), F.struct("marked_at", "last_day")))), lambda x: x["last_day"]).alias("marked"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct("at", "last_day"))), 1, MOST_CANDIDATES), lambda x: x["last_day"]).alias("any"),
        F.min(F.when(F.col("marked") & (F.col("last_day") >= now), F.col("last_day"))).alias("next"),
        F.max(F.when(F.col("marked"), F.col("last_day"))).alias("last"),
    )
    none = F.array().cast("array<date>")
    found = per_doc.select(
        "id",
        F.when(F.size("marked") > 0, F.coalesce("next", "last")).alias("expiry_on"),
        F.when(F.size("marked") == 1, "rule").when(F.size("marked") > 1, "fallback").alias("expiry_source"),
        F.when(F.size("marked") == 1, none).when(F.size("marked") > 1, F.col("marked")).when(expires, F.col("any")).otherwise(none).alias("candidates"),
    )
    found = docs.select("id").join(found, "id", "left").withColumn("candidates", F.coalesce("candidates", none))
    usable = rows.join(found.select("id", "expiry_on"), "id").filter((F.col("date") <= F.date_add(now, 1)) & ~F.coalesce(F.col("last_day") == F.col("expiry_on"), F.lit(False)))
    latest = lambda ok: F.max(F.when(ok, F.col("date")))
    issued = usable.groupBy("id").agg(F.coalesce(latest(F.col("issue")), latest(kind.isin(dims.MONTHLY) & (F.col("precision") == "month")), F.max("date")).alias("issued_on"))
    return found.join(issued, "id", "left").select("id", "expiry_on", "expiry_source", "candidates", "issued_on")
