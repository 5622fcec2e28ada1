from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.llm import quality
from papertrail.llm.queries import fold
from tests.llm.conftest import ROWS, SF


def test_sum_of_squares_is_the_sum_over_pairs():
    random = np.random.default_rng(3)
    m = quality.Machine(0.3, random.normal(size=50), random.normal(size=(50, quality.RANK)))
    rows = [(random.choice(50, n, replace=False), random.normal(size=n)) for n in (1, 2, 7, 30)]
    starts = np.cumsum([0] + [len(x) for x, _ in rows[:-1]])
    got = m.raw(np.concatenate([x for x, _ in rows]), np.concatenate([v for _, v in rows]), starts)
    for (x, v), g in zip(rows, got, strict=True):
        pairs = sum(m.v[x[i]] @ m.v[x[j]] * v[i] * v[j] for i, j in combinations(range(len(x)), 2))
        assert g == pytest.approx(m.bias + m.w[x] @ v + pairs)


def test_learns_what_only_a_pair_tells():
    random = np.random.default_rng(5)
    bits = random.integers(0, 2, (4000, 2))
    rows = [(np.array([a, 2 + b], "i4"), np.ones(2, "f4")) for a, b in bits]
    m = quality.train(rows[:3000], (bits[:3000, 0] ^ bits[:3000, 1]).astype(float), 4)
    raw = m.raw(np.concatenate([x for x, _ in rows[3000:]]), np.concatenate([v for _, v in rows[3000:]]), np.arange(0, 2000, 2))
    assert ((raw > 0) == (bits[3000:, 0] ^ bits[3000:, 1])).mean() > 0.95  # no sum of single weights gets beyond 0.75


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    machine = quality.fit(docs, labels.filter(fold("doc_id", 5) != 0))
    got = {r["doc_id"]: r for r in quality.score(docs, machine, extra={"doc_id": F.col("doc_id")}).collect()}
    assert len(got) == docs.count()
    held = labels.filter(fold("doc_id", 5) == 0).collect()
    good, bad = ([got[r["doc_id"]]["score"] for r in held if r["quality"] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([got[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.93
    again = quality.fit(docs.repartition(7), labels.filter(fold("doc_id", 5) != 0).repartition(3))
    assert np.array_equal(again.w, machine.w) and np.array_equal(again.v, machine.v)


def test_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (7, None), (None, 1)], "doc_id long, quality int")
    machine = quality.fit(odd, labels)
    got = quality.score(odd, machine, extra={"doc_id": F.col("doc_id")}).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    texts = quality.score(odd.select("text"), machine, extra={"t": F.col("text")}).collect()  # without metadata
    assert len(texts) == len(ROWS) and by_id.keys() >= {1, 2, 3, None}
    assert quality.score(none, machine, extra={"doc_id": F.col("doc_id")}).count() == 0
    assert quality.score(clashing, machine, extra={"text": F.col("doc_id"), "metadata": F.col("lang")}).count() == len(ROWS)
    untaught = quality.fit(odd, labels.filter("false"))
    assert {r["score"] for r in quality.score(odd, untaught, extra={"doc_id": F.col("doc_id")}).collect()} == {0.5}


def test_features_of_whole_texts():
    head = "a fine text " * 2000
    one, other = (quality.features(t.encode(), len(t), []) for t in (head, head + "| # $"))
    assert len(one[0]) < len(other[0])  # what comes last counts
    assert quality.features(b"", 0, [None])[1].shape == (quality.STATISTICS + 2,)
