"""Queries over pages of words and lines with boxes, written from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papertrail.functions.ids import valid_py
from papertrail.operators import pages
from papertrail.plans import adapters as a
from papertrail.plans.registry import oracle, query

#: Valid twelve-digit numbers, which aren't when their parts are read from behind.
NUMBERS = [n for n in (f"{2341000000 + 1234567 * k}{d:02d}" for k in range(9) for d in range(100)) if valid_py(n) and not valid_py(n[8:] + n[4:8] + n[:4])][::9][:8]
_HINDI = "०१२३४५६७८९"


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _items(spark, sf) -> DataFrame:
    """Line items, numbered within their order."""
    within = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return a.table(spark, sf, "lineitem").withColumn("l_linenumber", F.row_number().over(within))


_ITEMS = f"items AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS l_linenumber) FROM lineitem)"


def _words(spark, sf) -> DataFrame:
    """Each line item as a row of words on its order's page, 40 high: a number in one word or three, a wrong one, one of which
    a word has no box, one whose words stand in another order and a little lower, and one with a word that is too low."""
    way, y = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.col("l_linenumber") * 40.0
    number = F.element_at(F.lit(NUMBERS), (F.col("l_linenumber") % len(NUMBERS) + 1).cast("int"))
    part = lambda k: F.substring(number, 4 * k + 1, 4)
    wrong = F.concat(F.substring(number, 9, 3), ((F.right(number, F.lit(1)).cast("int") + 1) % 10).cast("string"))

    def word(n: int, text, left, right, low=0.0, boxed=True):  # noqa: ANN001, ANN202
        box = lambda c: F.when(F.lit(boxed), c)
        return F.struct(F.lit(n).alias("n"), text.alias("text"), box(F.lit(float(left))).alias("left"), box(y + low).alias("top"), box(F.lit(float(right))).alias("right"), box(y + low + 20).alias("bottom"))

    hindi = lambda k: F.translate(part(k), "0123456789", _HINDI)
    ways = [
        [word(1, part(0), 10, 50), word(2, part(1), 60, 100), word(3, part(2), 110, 150)],
        [word(1, number, 10, 130)],
        [word(1, part(0), 10, 50), word(2, part(1), 60, 100), word(3, wrong, 110, 150)],
        [word(1, part(0), 10, 50), word(2, part(1), 60, 100, boxed=False), word(3, part(2), 110, 150)],
        [word(3, hindi(0), 10, 50, 9.0), word(2, part(1), 60, 100), word(1, part(2), 110, 150, 9.0)],
        [word(1, part(0), 10, 50), word(2, part(1), 60, 100, 11.0), word(3, part(2), 110, 150)],
    ]
    own = F.array(*ways[0])
    for n, w in enumerate(ways):
        own = F.when(way == n, F.array(*w)).otherwise(own)
    both = F.concat(F.array(word(0, F.lit("no"), 0, 8), word(9, F.lit("ok"), 160, 170)), own)
    rows = _items(spark, sf).select("l_orderkey", "l_linenumber", F.explode(both).alias("w"))
    return rows.select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 10 + F.col("w.n")).alias("word"), "w.text", *(F.col(f"w.{c}") for c in pages.BOX))


_ROWS = _ITEMS + ", rows AS (SELECT l_orderkey AS page_id, l_linenumber AS n, (l_orderkey + l_linenumber) % 6 AS way, l_linenumber * 40.0::DOUBLE AS y, [" + ", ".join(f"'{n}'" for n in NUMBERS) + f"][l_linenumber % {len(NUMBERS)} + 1] AS digits FROM items)"


@query
def mask_covers_of_items(spark, sf):
    """What is to be covered of the numbers on each page."""
    return pages.covers(_words(spark, sf)).select("page_id", "digits", "word", *(F.round(c, 6).alias(c) for c in pages.BOX))


oracle(
    mask_covers_of_items,
    f"""WITH {_ROWS}, c(way, w, l, r, low) AS (VALUES (0, 1, 10.0, 50.0, 0.0), (0, 2, 60.0, 100.0, 0.0), (1, 1, 10.0, 90.0, 0.0), (4, 3, 10.0, 50.0, 9.0), (4, 2, 60.0, 100.0, 0.0))
    SELECT page_id, digits, (n * 10 + w)::INT AS word, (l - 3)::DOUBLE AS "left", (y + low - 4)::DOUBLE AS top, (r + 3)::DOUBLE AS "right", (y + low + 24)::DOUBLE AS bottom FROM rows JOIN c USING (way)""",
)


@query
def mask_plans_of_items(spark, sf):
    """Whether all numbers that are read on a page have boxes."""
    return pages.mask_plans(_words(spark, sf))


oracle(
    mask_plans_of_items,
    f"""WITH {_ROWS} SELECT page_id, count(*) FILTER (way <> 2) AS found, count(*) FILTER (way IN (0, 1, 4)) AS boxed, count(*) FILTER (way IN (3, 5)) = 0 AS complete FROM rows GROUP BY page_id""",
)


def _lines(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What three recognisers have read: lines 60 high on their order's page, the other's shifted by what is sold of an item."""
    i = _items(spark, sf)
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    line = lambda text, left, low, sure: (key.alias("page_id"), n.alias("line"), text.alias("text"), sure.alias("confidence"), left.cast("double").alias("left"), (n * 60.0 + low).alias("top"), (left + 200.0).alias("right"), (n * 60.0 + low + 40.0).alias("bottom"))
    sure = F.when((key + n) % 3 == 0, 0.9).otherwise(0.4)
    first = i.select(*line(F.concat(F.lit("item "), F.col("l_partkey").cast("string")), F.lit(0), F.lit(0.0), sure))
    hindi = F.concat(F.when(n % 2 == 0, F.lit("वस्तु ")).otherwise(F.lit("item ")), F.col("l_suppkey").cast("string"))
    other = i.select(*line(hindi, F.lit(0) + F.col("l_quantity") * 4, F.col("l_quantity") / 2, F.lit(0.8)))
    full = F.concat(F.lit("line read at length "), F.col("l_partkey").cast("string"))
    fallback = i.filter(key % 4 != 0).select(*line(full, F.lit(0), F.lit(0.0), F.lit(0.9)))
    return first, other, fallback


_USEFUL = r"length(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
_READ = f"WITH {_ITEMS}, " + """f AS (SELECT l_orderkey AS page_id, l_linenumber AS n, 'item ' || l_partkey AS text, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 0.9 ELSE 0.4 END AS sure, 0.0::DOUBLE AS l, l_linenumber * 60.0::DOUBLE AS t FROM items),
o AS (SELECT l_orderkey AS page_id, l_linenumber AS n, 'वस्तु ' || l_suppkey AS text, 0.8 AS sure, l_quantity * 4 AS l, l_linenumber * 60.0::DOUBLE + l_quantity / 2 AS t FROM items WHERE l_linenumber % 2 = 0),
gone AS (SELECT DISTINCT f.page_id, f.n FROM f JOIN o ON f.page_id = o.page_id AND least(f.l, o.l) + 200 > greatest(f.l, o.l) AND least(f.t, o.t) + 40 > greatest(f.t, o.t)
  AND (least(f.l, o.l) + 200 - greatest(f.l, o.l)) * (least(f.t, o.t) + 40 - greatest(f.t, o.t)) / 8000.0 > 0.5),
m AS (SELECT 'first' AS recogniser, * FROM f WHERE (page_id, n) NOT IN (SELECT (page_id, n) FROM gone) UNION ALL SELECT 'other', * FROM o)
"""


@query
def merged_readings(spark, sf):
    """The lines of two recognisers as one page's, in reading order."""
    first, other, _ = _lines(spark, sf)
    return pages.merged_lines(first, other).select("page_id", "place", "recogniser", "text")


oracle(merged_readings, _READ + "SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY t, l, recogniser, n) AS place, recogniser, text FROM m")


@query
def page_readings(spark, sf):
    """The reading of each page: the two recognisers' or, where they read little or doubtfully, the fallback's."""
    return pages.readings(*_lines(spark, sf))


oracle(
    page_readings,
    _READ
    + f""", p AS (SELECT page_id, string_agg(text, chr(10) ORDER BY t, l, recogniser, n) AS text, count(*) FILTER (sure < 0.5) * 2 > count(*) AS doubtful FROM m GROUP BY page_id),
b AS (SELECT l_orderkey AS page_id, string_agg('line read at length ' || l_partkey, chr(10) ORDER BY l_linenumber) AS text FROM items WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey),
u AS (SELECT p.page_id, p.text, b.text AS more, doubtful, {_USEFUL.format("p.text")} AS useful, coalesce({_USEFUL.format("b.text")}, 0) AS useful_more FROM p LEFT JOIN b USING (page_id)),
k AS (SELECT *, (useful < 40 OR doubtful) AND useful_more > useful AS takes FROM u)
SELECT page_id, CASE WHEN takes THEN 'merged+fallback' ELSE 'merged' END AS engine, CASE WHEN takes THEN useful_more ELSE useful END AS useful, doubtful, CASE WHEN takes THEN more ELSE text END AS text FROM k""",
)
