"""Joins that prune: close vectors, close words, places, near duplicates, held against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.functions.text import damerau_distance, jaccard, osa_distance, word_set
from papertrail.operators import dedup, terms, vector_join


def vectors(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, vector array<double>").repartition(4)


@pytest.mark.parametrize(("least", "spread"), [(0.95, 0.05), (0.8, 0.3), (0.35, 1.0)])
def test_close_pairs_equal_all_pairs(spark, monkeypatch, least, spread):
    monkeypatch.setattr(vector_join, "PER_PIVOT", 50)
    random = np.random.default_rng(7)
    centres = random.normal(size=(20, 24))
    x = centres[random.integers(0, 20, 700)] + spread * random.normal(size=(700, 24))
    x[:40] = x[0]  # one vector many times
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = vector_join.close_pairs(vectors(spark, enumerate(x)), least=least).collect()
    dots = x @ x.T
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(dots, 1) >= least + 1e-9), strict=True)}
    pairs = [(r["a"], r["b"]) for r in got]
    assert len(set(pairs)) == len(pairs) and want <= set(pairs)
    assert all(abs(dots[a, b] - r["cosine"]) < 1e-9 and dots[a, b] >= least - 1e-9 for r in got for a, b in [(r["a"], r["b"])])


def test_clusters_are_not_compared_with_each_other(spark, monkeypatch):
    """Visitors of a chunk are its own cluster's."""
    monkeypatch.setattr(vector_join, "PER_PIVOT", 100)
    random = np.random.default_rng(8)
    x = np.eye(16)[np.arange(1600) % 16] + 0.01 * random.normal(size=(1600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = vector_join.close_pairs(vectors(spark, enumerate(x)), least=0.95)
    assert pairs.count() == 16 * 100 * 99 // 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert vector_join.close_pairs(none, least=0.9).count() == 0
    some = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    assert [tuple(r) for r in vector_join.close_pairs(some, least=0.9).collect()] == [(2, 3, 1.0)]


def test_cascade_equals_every_pair(spark):
    """Also where one vector, or one text, belongs to many documents."""
    random = np.random.default_rng(9)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        v = np.eye(4)[i % 3] + 0.1 * random.normal(size=4) if i % 4 else np.eye(4)[0]
        text = None if i % 50 == 0 else "" if i % 50 == 1 else " ".join(random.choice(words, 10, replace=False)) if i % 2 else "the same words in all of these"
        rows.append((i, text, (v / np.linalg.norm(v)).tolist()))
    rows += [(1000, "no vector", None)]
    got = {r["id"]: (r["dup_of"], round(r["cosine"], 6)) for r in dedup.near_duplicates(spark.createDataFrame(rows, "id long, text string, vector array<double>").repartition(3)).collect()}
    sets = {i: {w for w in (t or "").lower().split() if len(w) > 1} for i, t, _ in rows}
    want = {}
    for i, _, v in rows[:-1]:
        best = None
        for j, _, w in rows[:i]:
            cos, both = float(np.dot(v, w)), sets[i] | sets[j]
            if cos >= 0.95 and (not both or len(sets[i] & sets[j]) / len(both) >= 0.8):
                best = min(best or (9,), (-round(cos, 9), j))
        if best:
            want[i] = (best[1], round(-best[0], 6))
    assert len(want) > 100 and got == want


def test_cascade_with_vectors_apart(spark):
    """Vectors that have no text have no answer; copies of a vector that isn't close to itself are no duplicates."""
    texts = spark.createDataFrame([(1, "same words here"), (2, "same words here"), (3, "same words here"), (4, "same words here"), (5, "no vector")], "id long, text string")
    apart = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [0.6, 0.8]), (4, [0.8, 0.6]), (6, [0.6, 0.8])], "id long, vector array<double>")
    found = lambda *a, **b: [(r["id"], r["dup_of"], round(r["cosine"], 6)) for r in dedup.near_duplicates(*a, **b).collect()]
    assert found(texts, vectors=apart) == [(4, 3, 0.96)]
    assert found(texts.join(apart, "id")) == [(4, 3, 0.96)]


def test_only_sets_that_are_asked_for(spark):
    sets = spark.range(2000).select("id", F.array(F.xxhash64("id")).alias("h"))
    kept = {r["id"] for r in dedup.only_of(sets, spark.range(0, 2000, 40)).collect()}
    assert set(range(0, 2000, 40)) <= kept and len(kept) < 100


def test_similar_texts_with_words_that_all_share(spark):
    random = np.random.default_rng(10)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*base, *(f"x{random.integers(0, 30)}" for _ in range(random.integers(0, 25)))])) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r["a"], r["b"]) for r in dedup.similar_texts(df, text=F.col("t")).collect()}
    sets = df.select("id", word_set(F.col("t")).alias("w"))
    one = sets.groupBy(F.array_sort("w").alias("w")).agg(F.min("id").alias("id"))
    a, b = one.select(F.col("id").alias("a"), F.col("w").alias("v")), one.select(F.col("id").alias("b"), "w")
    want = {(r["a"], r["b"]) for r in a.join(b, F.col("a") < F.col("b")).filter(jaccard(F.col("v"), F.col("w")) >= 0.8).collect()}
    assert len(want) > 500 and got == want


def test_close_terms_equal_all_pairs(spark):
    random = np.random.default_rng(11)
    word = lambda n: "".join(random.choice(list("abcd"), n))
    known = {word(random.integers(5, 11)) for _ in range(120)}
    said = {word(random.integers(3, 12)) for _ in range(400)} | {w[1] + w[0] + w[2:] for w in known} | {w[:-1] for w in known} | known
    frame = lambda c, words: spark.createDataFrame([(w,) for w in words], f"{c} string")
    slips = frame("term", known).withColumn("slips", terms.allowed_slips(F.col("term")))
    got = {(r["word"], r["term"], r["distance"]) for r in terms.close_terms(frame("word", said), slips).collect()}
    want = {(w, t, d) for w in said for t in known for d in [osa_distance(w, t, 2)] if d <= (2 if len(t) >= 8 else 1)}
    assert len(want) > 300 and got == want


def test_words_of_sets_are_not_shuffled(spark, monkeypatch):
    """Not for their order, whose counters may be any, nor with pairs whose signatures tell them apart."""
    random = np.random.default_rng(15)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(random.choice(base, 40, replace=False)) if i % 2 else " ".join([*base[:38], f"x{i % 9}", f"y{i % 7}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = df.select("id", F.array_sort(F.transform(word_set(F.col("t")), lambda x: F.xxhash64(x))).alias("h")).localCheckpoint()
    plan = dedup.word_prefixes(sets, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    words = {i: frozenset(t.split()) for i, t in rows}
    one = {w: min(i for i in words if words[i] == w) for w in set(words.values())}
    want = {(a, b): len(v & w) / len(v | w) for v, a in one.items() for w, b in one.items() if a < b and len(v & w) >= 0.8 * len(v | w)}
    for slots in (1, 7, 1 << 20):
        monkeypatch.setattr(dedup, "SLOTS", slots)
        monkeypatch.setattr(dedup, "CELL", 1000 if slots > 7 else 3)
        assert {(r["a"], r["b"]): r["similarity"] for r in dedup.similar_texts(df, text=F.col("t")).collect()} == want and len(want) > 100


def every_damerau(a, b):
    """Edits by search: of words that differ by a swap and what has come between, too."""
    from itertools import product

    def once(w):
        yield from (w[:i] + w[i + 1 :] for i in range(len(w)))
        yield from (w[:i] + x + w[i + k :] for i, k, x in product(range(len(w) + 1), (0, 1), "abcd"))
        yield from (w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1))

    near = {a: 0}
    for n in (1, 2):
        for w in list(near):
            for x in once(w):
                near.setdefault(x, n)
    return near.get(b, 3)


def test_letters_between_swapped_neighbours(spark):
    random = np.random.default_rng(13)
    word = lambda n: "".join(random.choice(list("abcd"), n))
    pairs = [(word(random.integers(0, 6)), word(random.integers(0, 6))) for _ in range(300)] + [("ca", "abc"), ("abc", "ca"), ("bcad", "babcd")]
    assert all(damerau_distance(a, b, 2) == every_damerau(a, b) for a, b in pairs)
    said = spark.createDataFrame([("enlichau",), ("queaitre",)], "word string")
    known = spark.createDataFrame([("einchauen", 2), ("eienlichau", 2), ("enlichuxa", 2), ("quearietr", 2), ("queaiert", 2)], "term string, slips int")
    got = {(r["word"], r["term"], r["distance"]) for r in terms.close_terms(said, known, between=True).collect()}
    assert got == {("enlichau", "eienlichau", 2), ("enlichau", "enlichuxa", 2), ("queaitre", "queaiert", 2)}
    assert {(r["word"], r["term"]) for r in terms.close_terms(said, known).collect()} == {("enlichau", "eienlichau"), ("queaitre", "queaiert")}


def test_cosines_that_reach_the_limit_by_rounding(spark, tmp_path):
    from papertrail.plans import queries as plans

    x = [(k, [1.0, 0.0] if k == 0 else [c, (1 - c * c) ** 0.5]) for k, c in enumerate([1.0, 0.3499996, 0.3499994, 0.35])]
    spark.createDataFrame(x, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["a"], r["b"], r["cosine"]) for r in plans.queries()["near_dup_vector"](spark, str(tmp_path)).collect()}
    assert {(b, c) for a, b, c in got if a == 0} == {(1, 0.35), (3, 0.35)}


def test_places_are_met_by_joins(spark):
    """A hundred thousand places, none of which is sent to all workers."""
    letters = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    places = spark.range(100_000).select(F.concat(F.lit("Port "), letters).alias("name")).unionByName(spark.createDataFrame([("Ongole",), ("Goa",), ("हैदराबाद",), ("New Port bcd",)], "name string"))
    said = [(1, "photos from ongol"), (2, "PORT bcdef, please"), (3, "new port bcd"), (4, "goa pics"), (5, "हैदराबादमें"), (6, "report bcdef"), (7, ""), (8, None)]
    found = terms.places_in(spark.createDataFrame(said, "message_id long, text string"), places)
    assert {r["message_id"]: r["place"] for r in found.collect()} == {1: "Ongole", 2: "Port bcdef", 3: "New Port bcd", 5: "हैदराबाद"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = terms.places_in(spark.createDataFrame(said, "message_id long, text string"), places)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Cartesian" not in plan


def test_an_index_brought_up_to_date_equals_a_new_one(spark, tmp_path):
    from papertrail.operators import kept_index, search

    def chunks(*rows):
        return spark.createDataFrame(list(rows), "chunk_id long, doc_id long, t string")

    path = str(tmp_path / "index")
    kept_index.create(chunks((1, 1, "salary slip march"), (2, 2, "passport copy"), (3, 3, "old words only")), path, text=F.col("t"))
    kept_index.update(path, chunks((2, 2, "passport renewed in march"), (4, 4, "a new slip")), chunks((3, 3, "")).select("chunk_id"), text=F.col("t"))
    kept_index.update(path, chunks((3, 3, "back again"), (2, 2, "passport march march")), chunks().select("chunk_id"), text=F.col("t"))
    kept_index.compact(spark, path, str(tmp_path / "new"))
    now = chunks((1, 1, "salary slip march"), (2, 2, "passport march march"), (3, 3, "back again"), (4, 4, "a new slip"))
    wanted = search.terms_of(spark.createDataFrame([(7, "march slip"), (8, "old words"), (9, "again")], "query_id long, text string"), text=F.col("text"))
    want = sorted(map(tuple, search.bm25(search.postings(now, text=F.col("t")), wanted, k=5).collect()))
    for place in (path, str(tmp_path / "new")):
        index = kept_index.read(spark, place)
        assert sorted(r["term"] for r in index.vocabulary.collect()) == sorted({w for r in now.collect() for w in r["t"].split()})
        assert sorted(map(tuple, search.bm25(index.postings, wanted, k=5, vocabulary=index.vocabulary, stats=index.stats).collect())) == want
