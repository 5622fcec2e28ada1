from itertools import permutations

from pyspark.sql import functions as F

from papertrail.llm.filter_audit import flagged, interactions
from tests.llm.conftest import ROWS

PROSE = " ".join(f"word{i}" for i in range(250))
AUDITED = [
    (1, PROSE, "en"),
    (2, PROSE, "en"),
    (3, PROSE, "de"),
    (3, PROSE, "de"),
    (4, "short", "en"),
    (5, "short", None),
    (6, PROSE + " 5 % off", ""),
    (7, "again " * 300, "en"),
    (8, PROSE.upper(), "de"),
    (9, None, "de"),
    (10, "", "de"),
    (None, "", None),
    (11, PROSE.replace(" ", " "), "fr"),  # one word: no-break spaces cut nothing
    (12, ("$ \x0b" * 150).strip(), "fr"),
]
LABELS = [(1, 1, 1), (2, 1, 0), (4, 0, 1), (4, 1, 0), (7, None, 1), (99, 1, 1), (None, 1, 1)]


def by_hand(rows, labels):
    """Each document goes through each order by itself."""
    out, parts = {}, {lang or "" for _, _, lang in rows}
    fails = {}
    for k, (i, t, _) in enumerate(rows):
        text = t or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        capitals = sum("A" <= c <= "Z" for c in text)
        earlier = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)
        fails[k] = {f for f, v in zip("ABCDE", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), earlier], strict=True) if v}
    for part in parts:
        mine = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        mark = lambda k, c: rows[k][0] is not None and any(x[0] == rows[k][0] and x[c] == 1 for x in labels)
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k]]
                earlier = [k for k in mine if k not in left and f in fails[k]]
                left = [k for k in left if k not in gone]
                removed_by[f] += len(gone)
                out[part, order, step] = [f, len(left), len(gone), len(earlier), sum(fails[k] == {f} for k in mine), sum(mark(k, 1) for k in gone), sum(mark(k, 2) for k in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(removed_by[v[0]])
    return out


def test_against_every_order_by_hand(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string").repartition(3)
    got = interactions(docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")).collect()
    want = by_hand(AUDITED, LABELS)
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        assert [r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] == want[r["part"], r["filter_order"], r["step"]], r


def test_odd_rows_and_a_text_that_most_rows_share(spark, odd, none, clashing):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = interactions(odd, labels).filter("step = 5").groupBy("part").agg(F.min("kept").alias("a"), F.max("kept").alias("b")).collect()
    assert {r["part"] for r in got} == {r[2] or "" for r in ROWS}
    assert all(r["a"] == r["b"] for r in got)  # what stays in the end doesn't depend on the order
    assert interactions(none, labels).count() == 0
    flags = flagged(clashing).collect()
    assert len(flags) == len(ROWS) and {r["id"] for r in flags if r["E"]} == {"id2", "id4"}  # a text's null id is no smaller one: null and empty texts are alike
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 != 0, F.lit("the same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    assert flagged(hot).filter("E").count() == 1999
