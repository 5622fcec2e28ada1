"""Queries over texts written from orders in many ways, so that what should be found in them is known: dates, expiry, issue."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail import dims
from papertrail.operators import chunks, dates
from papertrail.plans import adapters as a
from papertrail.plans.registry import oracle, query
from papertrail.storage import spread

TODAY = dt.date.fromisoformat(a.TODAY)


class Day(NamedTuple):
    """A date as it is written: which one (d is the order's, p forty days later, u forty years later, v two more), and how."""

    which: str
    java: str
    sql: str
    precision: str = "day"
    numeric: bool = False


class Paper(NamedTuple):
    """A kind of text. expiry, issued: the dates that should be picked; candidates: those that should be left to choose from."""

    doc_type: str | None
    parts: list[str | Day]
    expiry: str | None = None
    source: str | None = None
    candidates: str = ""
    issued: str | None = None


def slash(w: str) -> Day:
    return Day(w, "dd/MM/yyyy", "%d/%m/%Y", numeric=True)


def iso(w: str) -> Day:
    return Day(w, "yyyy-MM-dd", "%Y-%m-%d")


def long(w: str) -> Day:
    return Day(w, "d MMMM yyyy", "%-d %B %Y")


def american(w: str) -> Day:
    return Day(w, "MMMM d, yyyy", "%B %-d, %Y")


def dotted(w: str) -> Day:
    return Day(w, "dd.MM.yyyy", "%d.%m.%Y", numeric=True)


def short_year(w: str) -> Day:
    return Day(w, "dd-MM-yy", "%d-%m-%y", numeric=True)


def month(w: str) -> Day:
    return Day(w, "MMM yyyy", "%b %Y", "month")


def month_number(w: str) -> Day:
    return Day(w, "MM/yyyy", "%m/%Y", "month")


PAPERS = [
    Paper("HEALTH_INSURANCE", ["Policy period ", slash("d"), " to ", slash("u")], "u", "rule", "", "d"),
    Paper("UTILITY_BILL", ["Due date\n", long("u")], "u", "rule"),
    Paper("UTILITY_BILL", [american("u"), "\nlast date"], "u", "rule"),
    Paper("WARRANTY", ["valid till ", iso("u"), "\nrenewal ", dotted("v"), "\nissued ", short_year("d")], "u", "fallback", "u,v", "d"),
    Paper("PASSPORT", ["exp. ", month("u")], "u", "rule"),
    Paper("PASSPORT", ["validity ", month_number("u"), "\nthank you"], "u", "rule"),
    Paper("SALARY_SLIP", ["Salary for the month of\n", month("d"), "\nprinted ", slash("p")], None, None, "", "d"),
    Paper("SALARY_SLIP", [month_number("d"), "\nnoted ", slash("p")], None, None, "", "d"),
    Paper("PAN", [month_number("d"), "\nnoted ", slash("p")], None, None, "", "p"),
    Paper(None, [slash("d"), " to ", slash("u")], None, None, "", "d"),
    Paper(None, ["Cover\nfor ", iso("d"), " ~ ", iso("u")], "u", "rule", "", "d"),
    Paper("VOTER_ID", ["date of birth ", long("d"), " valid"], None, None, "", "d"),
    Paper("RENT_AGREEMENT", ["from ", slash("u")], None, None, "u"),
    Paper("LIFE_INSURANCE", ["valid from ", long("d"), " valid till ", american("u")], "u", "rule", "", "d"),
    Paper("WARRANTY", ["valid till ", slash("d"), " or ", slash("p"), "\nvalid till ", iso("p")], "p", "fallback", "d,p", "d"),
    Paper("PASSPORT", ["గడువు\n", dotted("u"), "\nजारी ", iso("d")], "u", "rule", "", "d"),
]

_DAYS = {
    "d": (lambda d: d, "d"),
    "p": (lambda d: F.date_add(d, 40), "(d + 40)"),
    "u": (lambda d: F.add_months(d, 480), "(d + INTERVAL 480 MONTH)::DATE"),
    "v": (lambda d: F.add_months(d, 504), "(d + INTERVAL 504 MONTH)::DATE"),
}


def written(spark, sf) -> DataFrame:
    """Each order as one of the papers: id, doc_type, text."""
    orders = a.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")

    def text(p: Paper) -> Column:
        return F.concat(*(F.lit(x) if isinstance(x, str) else F.date_format(_DAYS[x.which][0](d), x.java) for x in p.parts))

    kind = F.element_at(F.array(*(F.lit(p.doc_type).cast("string") for p in PAPERS)), (k % len(PAPERS) + 1).cast("int"))
    which = k % len(PAPERS)
    whole = F.lit(None).cast("string")
    for n, p in enumerate(PAPERS):
        whole = F.when(which == n, text(p)).otherwise(whole)
    return orders.select(k.alias("id"), kind.alias("doc_type"), whole.alias("text"))


_O = f"WITH o AS (SELECT o_orderkey AS id, o_orderkey % {len(PAPERS)} AS n, o_orderdate::DATE AS d FROM orders)"


def _found(n: int, p: Paper) -> str:
    """The dates of a paper with their places, from the parts that it is made of."""
    rows, line, before = [], 0, ["''"]
    for x in p.parts:
        if isinstance(x, str):
            head, *rest = x.split("\n")
            before.append("'" + head + "'")
            if rest:
                line, before = line + len(rest), ["'" + rest[-1] + "'"]
            continue
        day, text = _DAYS[x.which][1], f"strftime({_DAYS[x.which][1]}, '{x.sql}')"
        start = f"length({' || '.join(before)})"
        first, last = (f"date_trunc('month', {day})::DATE", f"last_day({day})") if x.precision == "month" else (day, day)
        ambiguous = f"day({day}) <= 12 AND day({day}) <> month({day})" if x.numeric else "false"
        rows.append(f"SELECT id, {line} AS line, {start} AS start, {start} + length({text}) AS \"end\", {first}::VARCHAR AS date, '{x.precision}' AS precision, {last}::VARCHAR AS last_day, {text} AS raw, {ambiguous} AS ambiguous FROM o WHERE n = {n}")
        before.append(text)
    return " UNION ALL ".join(rows)


@query
def dates_of_papers(spark, sf):
    """All shapes of dates with their places, in sixteen kinds of text."""
    return dates.extract(written(spark, sf), TODAY).select("id", "line", "start", "end", "date", "precision", "last_day", "raw", "ambiguous")


oracle(dates_of_papers, _O + " " + " UNION ALL ".join(_found(n, p) for n, p in enumerate(PAPERS)))


@query
def expiry_of_papers(spark, sf):
    """Expiry and issue dates: marked on the line, on the line beside, by periods, by none, by several."""
    p = dates.pick(written(spark, sf), TODAY)
    return p.select("id", "expiry_on", "expiry_source", F.array_join(F.transform("candidates", lambda d: d.cast("string")), ",").alias("candidates"), "issued_on")


def _picked(n: int, p: Paper) -> str:
    """A month that expires does so on its last day; a month of issue is its first."""
    kinds = {x.which: x.precision for x in p.parts if isinstance(x, Day)}
    day = lambda w: _DAYS[w][1]
    ends = lambda w: f"last_day({day(w)})" if kinds[w] == "month" else day(w)
    begins = lambda w: f"date_trunc('month', {day(w)})::DATE" if kinds[w] == "month" else day(w)
    expiry = f"{ends(p.expiry)}::VARCHAR" if p.expiry else "NULL"
    choice = " || ',' || ".join(f"{ends(w)}::VARCHAR" for w in p.candidates.split(",")) if p.candidates else "''"
    issued = f"{begins(p.issued)}::VARCHAR" if p.issued else "NULL"
    return f"SELECT id, {expiry} AS expiry_on, {_text(p.source)} AS expiry_source, {choice} AS candidates, {issued} AS issued_on FROM o WHERE n = {n}"


def _text(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


oracle(expiry_of_papers, _O + " " + " UNION ALL ".join(_picked(n, p) for n, p in enumerate(PAPERS)))


# ---- chunks by word pieces

_MOST_PIECES = 5000


def _vocabulary(spark, sf) -> dict[str, int]:
    """Letters and digits, and the most frequent short words of the benchmark, each as a beginning and as a continuation."""
    word = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    short = a.table(spark, sf, "benchmark").select(word.alias("w")).filter(F.length("w").between(2, 4))
    common = short.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(_MOST_PIECES)
    pieces = [*"abcdefghijklmnopqrstuvwxyz0123456789", *(r["w"] for r in common.collect())]
    return {t: n for n, t in enumerate(["[UNK]", "[CLS]", "[SEP]", *pieces, *(f"##{p}" for p in pieces)])}


@query
def chunks_by_pieces(spark, sf):
    """Whole texts in chunks of 110 pieces with 20 of overlap, behind the label; first the title, as far as it fits."""
    d = spread(a.vault(spark, sf).select("id", "ocr_text", "title_en", dims.label_of(F.col("doc_type")).alias("label")))
    c = chunks.document_chunks(d, text="ocr_text", facts="title_en", label="label", vocabulary=_vocabulary(spark, sf))
    return c.select("id", "chunk_ix", F.sha2("text", 256).alias("sha256"), "pieces")


_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MARK = r"\p{P}$+<=>^`|~"
oracle(
    chunks_by_pieces,
    a.VAULT.replace("WITH", "WITH RECURSIVE", 1)
    + rf""", short AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 4 GROUP BY w ORDER BY n DESC, w LIMIT {_MOST_PIECES}),
vocab AS MATERIALIZED (SELECT w FROM short UNION SELECT unnest(regexp_extract_all('abcdefghijklmnopqrstuvwxyz0123456789', '.'))),
docs AS (SELECT id, label, list_filter(regexp_split_to_array(ocr_text, '{_BLANK}'), lambda w: w <> '') AS words, label || ' · ' || owner_name AS title FROM vault),
every AS (SELECT DISTINCT unnest(words) AS word FROM docs UNION SELECT DISTINCT unnest(string_split(title, ' ')) FROM docs),
parts AS (SELECT word, unnest(regexp_extract_all(strip_accents(lower(word)), '[^{_MARK}]+|[{_MARK}]')) AS part FROM every),
cut(part, rest, n) AS (
  SELECT DISTINCT part, part, 0 FROM parts WHERE regexp_matches(part, '^[a-z0-9]{{1,100}}$')
  UNION ALL
  SELECT part, substr(rest, 1 + CASE WHEN substr(rest, 1, 4) IN (SELECT w FROM vocab) THEN length(substr(rest, 1, 4)) WHEN substr(rest, 1, 3) IN (SELECT w FROM vocab) THEN length(substr(rest, 1, 3)) WHEN substr(rest, 1, 2) IN (SELECT w FROM vocab) THEN length(substr(rest, 1, 2)) ELSE 1 END), n + 1 FROM cut WHERE rest <> ''
), sizes AS (SELECT word, sum(coalesce(n, 1))::INT AS n FROM parts LEFT JOIN (SELECT part, n FROM cut WHERE rest = '') USING (part) GROUP BY word),
places AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS i FROM docs),
sums AS (SELECT id, list_prepend(0, list(s ORDER BY i)) AS c FROM (SELECT id, i, (sum(coalesce(n, 0)) OVER (PARTITION BY id ORDER BY i))::INT AS s FROM places LEFT JOIN sizes USING (word)) GROUP BY id),
step(id, k, b, e) AS (
  SELECT id, 1, 0, greatest(1, len(list_filter(c, lambda x: x <= 110)) - 1) FROM sums WHERE len(c) > 1
  UNION ALL
  SELECT id, k + 1, b2, greatest(b2 + 1, len(list_filter(c, lambda x: x <= c[b2 + 1] + 110)) - 1)
  FROM (SELECT s.id, s.k, m.c, greatest(s.b + 1, len(list_filter(m.c, lambda x: x < m.c[s.e + 1] - 20))) AS b2 FROM step s JOIN sums m ON m.id = s.id WHERE s.e < len(m.c) - 1)
), made AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS k, b, e, c[e + 1] - c[b + 1] AS n FROM step JOIN sums USING (id) WHERE c[e + 1] > c[b + 1])
SELECT id, k::INT AS chunk_ix, sha256(label || '. ' || array_to_string(words[b + 1 : e], ' ')) AS sha256, n AS pieces FROM made JOIN docs USING (id)
UNION ALL
SELECT id, 0, sha256(title), sum(n)::INT FROM (SELECT id, title, unnest(string_split(title, ' ')) AS word FROM docs) JOIN sizes USING (word) GROUP BY id, title
""",
)
