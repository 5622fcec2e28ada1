import math

import numpy as np
from pyspark.sql import functions as F

from papertrail.llm import negatives
from papertrail.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, row string, chunk int, score double"


def by_hand(rows, positives=5, count=10, low=30, high=90):
    """Every anchor against every row, in whole numbers."""
    own = [(i, v, y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in own]
    out = []
    for a, (i, v, y) in enumerate(own):
        if i % 100:
            continue
        score = [(-sum(p * q for p, q in zip(v, w, strict=False)), j, b) for b, (j, w, _) in enumerate(own)]
        near = sorted(s for s in score if own[s[2]][2] == y and s[2] != a)[:positives]
        for s, j, _ in near:
            fit = sorted(t for t in score if own[t[2]][2] != y and low * -s <= 100 * -t[0] <= high * -s)[:count]
            out += [(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, hard_negatives(df, label=label, anchor=F.col("vec_id") % 100 == 0).collect()))


def made(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "r", 2, 0.5) for i, v, y in rows], SCHEMA).repartition(5)


def test_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    random = np.random.default_rng(2)
    around = random.normal(size=(12, 16))
    rows = []
    for i in range(2500):
        v = around[i % 12] + 0.2 * random.normal(size=16) if i % 2 else random.normal(size=16)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(random.integers(0, 4))))
    same = [0.25] * 16
    rows += [(i, same, i % 3) for i in range(2500, 3800)]  # a third of all: one vector, whose ties go by id
    rows += [(4000, None, 1), (4100, same, None), (4200, [0.1, None], 1), (4300, [0.1, float("nan")], 1), (4400, [float("inf")], 1), (None, same, 1)]
    want = by_hand(rows)
    assert len(want) > 1000 and mined(made(spark, rows)) == want


def test_norms_differ_and_numbers_are_large(spark):
    random = np.random.default_rng(4)
    rows = [(i, (random.normal(size=random.integers(0, 9)) * 10.0 ** random.integers(-2, 5)).tolist(), int(random.integers(0, 3))) for i in range(500)]
    assert mined(made(spark, rows)) == by_hand(rows)


def test_few_rows(spark):
    assert mined(made(spark, [])) == []
    assert mined(made(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2)])) == []  # no anchor
    assert mined(made(spark, [(100, [1.0, 0.0], 1)])) == []
    rows = [(100, [1.0, 0.0], 1), (101, [1.0, 0.1], 1), (102, [0.5, 0.5], 2), (102, [0.5, 0.5], 2), (103, [-1.0, 0.0], 1), (104, [], 3), (200, [0.0, 0.0], 2)]
    assert mined(made(spark, rows)) == by_hand(rows)  # repeated rows are each found


def test_pruning_leaves_chunks_out(spark, monkeypatch):
    """Of well separated groups, an anchor visits its own group's chunks only."""
    monkeypatch.setattr(negatives, "LEAST_ROWS", 64)
    random = np.random.default_rng(6)
    rows = [(i, (8 * np.eye(16)[i % 16] + 0.01 * random.normal(size=16)).tolist(), i // 16 % 2) for i in range(3200)]
    df = made(spark, rows).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), F.col("embedding").alias("v"))
    index = negatives.index(df)
    visits = []
    scan = negatives._scan
    monkeypatch.setattr(negatives, "_scan", lambda i, v, k, same: (visits.append(v.count()), scan(i, v, k, same))[1])
    probes = index.rows.filter("anchor").select("chunk", "row", "label", "x", F.array(F.lit(2**63 - 1)).alias("caps"), F.array(F.lit(-(2**63))).alias("floors"))
    assert negatives.search(index, probes, 5, same=True).count() == 160
    chunks = index.rows.select("chunk").distinct().count()
    assert visits[0] == 32 and visits[1] < 0.25 * 32 * chunks
