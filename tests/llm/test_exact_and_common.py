import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papertrail.llm import common
from papertrail.llm.common import join_groups, without, word_blocks
from papertrail.llm.components import components
from papertrail.llm.exact_dedup import drop_exact, exact_groups
from tests.llm.conftest import ROWS


@given(st.text(alphabet="aB \n\té", max_size=80), st.integers(0, 3), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_word_blocks_lose_and_repeat_nothing(text, keep, size):
    raw = text.encode()
    words, n = raw.lower().split(), keep + 1
    got = [b" ".join(b[i : i + n]) for b in word_blocks(raw, keep, size) for i in range(len(b) - keep)]
    assert got == [b" ".join(words[i : i + n]) for i in range(len(words) - keep)]


def test_groups(odd):
    got = exact_groups(odd).collect()
    assert len(got) == len(ROWS)
    by_text = defaultdict(list)
    for r in ROWS:
        by_text[r[1] or ""].append(r[0])
    for r in got:
        ids = next(v for v in by_text.values() if r["doc_id"] in v)
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(by_text)
    assert {r["doc_id"] for r in got if r["kept"]} == {2, 4, 5, None, 6, 7, 8}


def test_digests_and_full_hash(odd):
    got = exact_groups(odd, extra={"d": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    assert all(r["full_hash"] in (None, r["d"]) for r in got)
    assert hashlib.sha256(b"").hexdigest() in {r["full_hash"] for r in got}


def test_drop(odd, none):
    kept = drop_exact(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t) for i, t in {(2, ROWS[0][1]), (4, ""), (5, "  \n "), (None, "kein Text ohne Kennung"), (6, ROWS[7][1]), (7, ROWS[8][1]), (8, ROWS[9][1])})
    assert exact_groups(none).count() == 0 and drop_exact(none).count() == 0


def test_without(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(1000)], "k long, v string")
    drops = spark.createDataFrame([(i,) for i in range(0, 1000, 3)] + [(None,)], "k long")
    assert sorted(r["k"] for r in without(df, drops, {"k": F.col("k")}).collect()) == [i for i in range(1000) if i % 3]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 3), (7, 5), (9, 8), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 3: 3, 5: 3, 7: 3, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_text_ids_and_clashing_columns(clashing):
    rows = [tuple(r) for r in clashing.collect()]
    kept = drop_exact(clashing)
    assert kept.columns == clashing.columns and set(map(tuple, kept.collect())) <= set(rows)
    got = exact_groups(clashing, extra={"row": F.col("`a.b`"), "_suspect": F.lit("x")}).collect()
    assert {r["keep_id"] for r in got if r["doc_id"] == "id1"} == {"id2"} and {r["_suspect"] for r in got} == {"x"}
    assert len(kept.collect()) == sum(r["kept"] for r in got) == len({r[1] or "" for r in rows})
    assert sorted(map(str, without(clashing, clashing.sparkSession.createDataFrame([("id7",)], "doc_id string"), {"doc_id": F.col("doc_id")}).collect())) == sorted(str(r) for r in clashing.collect() if r["doc_id"] != "id7")


def test_hot_groups_are_joined_where_they_are(spark):
    rows = spark.createDataFrame([(i, 7 if i < 1500 else i) for i in range(3000)] + [(5000, None)], "i long, k long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumnRenamed("k", "g").filter("g % 2 = 1")
    got = {(r["i"], r["k"], r["n"]) for r in join_groups(rows, groups, lambda a, b: a["k"] == b["g"], "n").collect()}
    assert got == {(r["i"], r["k"], (1500 if r["k"] == 7 else 1) if r["k"] is not None and r["k"] % 2 else None) for r in rows.collect()}


def test_membership_of_too_many(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_MEMBERS", 10)
    df = spark.range(1000).withColumnRenamed("id", "k")
    drops = spark.range(0, 1000, 3).withColumnRenamed("id", "k")
    assert common.membership(drops.select(F.xxhash64("k").alias("h")), "h") is None
    assert sorted(r["k"] for r in without(df, drops, {"k": F.col("k")}).collect()) == [i for i in range(1000) if i % 3]
