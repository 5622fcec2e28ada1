from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from papertrail.llm import simhash
from tests.llm.conftest import ROWS


def slow_fingerprint(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    top = {f: f for f in set(fps)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(top), 2):
        if (a ^ b).bit_count() <= 2:
            top[find(a)] = find(b)
    return {f: find(f) for f in top}


def held_against_brute_force(got, rows):
    fps = [slow_fingerprint(t or "") for _, t in rows]
    groups = defaultdict(list)
    found = slow_components(fps)
    for (i, _), f in zip(rows, fps, strict=True):
        groups[found[f]].append(i)
    want = sorted((str(i), f"{f:016x}", str(min((x for x in groups[found[f]] if x is not None), default=None))) for (i, _), f in zip(rows, fps, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want


def test_query_equals_brute_force(spark, docs):
    held_against_brute_force(simhash.simhash_components(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_documents(odd, none):
    held_against_brute_force(simhash.simhash_components(odd).collect(), [(r[0], r[1]) for r in ROWS])
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_with_hot_segments(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    words = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (60, 3))} | {int(x) for x in rng.integers(0, 1 << 63, 50)}
    got = sorted((r["a"], r["b"]) for r in simhash.hamming_links(spark.createDataFrame([(w,) for w in words], "fp long")).distinct().collect())
    assert got == sorted((a, b) for a, b in combinations(sorted(words), 2) if (a ^ b).bit_count() <= 2)


def test_look_ups_are_never_broadcast(spark):
    """Their number is estimated as that of the words, of which each has 34."""
    words = spark.range(2000).select(F.xxhash64("id").alias("fp")).localCheckpoint()
    plan = simhash.hamming_links(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, copies = [], {}
    for i in range(120):
        words = rng.choice(vocabulary, 200).tolist()
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            for k in range(3):  # each changed word costs five of 196 shingles
                other = list(words)
                for at in rng.choice(200, 1 + k, replace=False):
                    other[at] = "changed"
                copies[1000 + 10 * i + k] = i
                rows.append((1000 + 10 * i + k, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.drop_near(df).collect()}
    text = dict(rows)
    assert set(range(120)) <= left
    missed = [c for c in copies if c in left and jaccard(shingles(text[c]), shingles(text[copies[c]])) >= 0.8]
    assert len(missed) <= 0.05 * len(copies)


def test_passages_repeated_unequally(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):  # one passage of 60 words once and twelve times: nearly equal sets
        words = [f"w{i}_{x}" for x in rng.integers(0, 5000, 300)]
        passage = words[100:160]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + 11 * passage))]
    assert all(jaccard(shingles(a), shingles(b)) >= 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    assert simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).count() == 20


def test_pairs_just_above_the_limit_are_found(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        words = [f"v{x}" for x in rng.integers(0, 100_000, 200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:179] + [f"v{x}" for x in rng.integers(0, 100_000, 21)]))]
    true = [k for k in range(200) if jaccard(shingles(rows[2 * k][1]), shingles(rows[2 * k + 1][1])) >= 0.8]
    left = {r["doc_id"] for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(true) > 190 and sum(2 * k in left and 2 * k + 1 in left for k in true) <= 1


def test_dropped_rows_resemble_kept_ones(docs):
    rows = {r["doc_id"]: shingles(r["text"]) for r in docs.dropDuplicates(["text"]).collect()}
    left = {r["doc_id"] for r in simhash.drop_near(docs.dropDuplicates(["text"])).collect()}
    for i in set(rows) - left:
        assert max(jaccard(rows[i], rows[j]) for j in left) >= 0.8


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_BLOCK", 4)
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(words[:k] + ["x"] + words[k + 1 :])) for k in range(30)]
    assert simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def template_pages(n, pairs, rng):
    """n texts that share a third of their words, so that all are linked as candidates, and `pairs` near copies among them."""
    common = [f"c{i}" for i in range(200)]
    bodies = [[f"b{x}" for x in rng.integers(0, 10**9, 60)] for _ in range(n)]
    for k in range(pairs):
        bodies[n - 1 - k] = [*bodies[k][:-2], "other", "words"]
    return [(i, " ".join(common + b)) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("block, n", [(1000, 4500), (7, 400)])
def test_a_large_group_of_leaders_equals_brute_force(spark, monkeypatch, block, n):
    """More distinct leaders than any block holds: all similar pairs are found nevertheless."""
    monkeypatch.setattr(simhash, "GROUP_BLOCK", block)
    monkeypatch.setattr(simhash, "GROUP_BYTES", 1 << 30)
    rows = template_pages(n, 40, np.random.default_rng(n))
    sets = [shingles(t) for _, t in rows]
    assert all(jaccard(sets[k], sets[n - 1 - k]) >= 0.8 for k in range(40)) and jaccard(sets[50], sets[51]) < 0.8
    monkeypatch.setattr(simhash, "near_links", lambda nodes, *plan: nodes.select(F.min("node").over(Window.partitionBy(F.lit(1))).alias("a"), F.col("node").alias("b")))
    left = {r["doc_id"] for r in simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id").collect()}
    assert len(left) == n - 40 and all((k in left) != (n - 1 - k in left) for k in range(40))


@pytest.mark.parametrize("cell", [1000, 40])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL_NODES", cell)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        words = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(0, 60)))]
        rows.append((3 * i, " ".join(words)))
        for k in (1, 2):
            other = list(words)
            for at in rng.integers(0, max(1, len(words)), int(rng.integers(0, 3))):
                if other:
                    other[int(at)] = "changed"
            rows.append((3 * i + k, " ".join(other)))
    sets = {i: shingles(t) for i, t in rows}
    want = sorted((a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.8)
    for least, own in ((0.8, want), (0.5, sorted((a, b) for a, b in combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.5))):
        df = spark.createDataFrame([(i, t.encode()) for i, t in rows], "node long, text binary")
        got = simhash.similar_pairs(df, 5, least)
        assert sorted(map(tuple, got.collect())) == own and len(own) > 100
    gone = {r["node"] for r in simhash.independent(spark.createDataFrame(want, "a long, b long")).collect()}
    assert all(a in gone or b in gone for a, b in want)
    partners = {i: {*(b for a, b in want if a == i), *(a for a, b in want if b == i)} for i in gone}
    assert all(partners[i] - gone for i in gone)


def test_followers_equal_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(60):
        base = [set(rng.integers(0, 40, int(rng.integers(0, 30))).tolist()) for _ in range(12)]
        sets = [b - set(rng.integers(0, 40, 2).tolist()) if rng.random() < 0.7 else b for b in base for _ in range(3)]
        leaders, want = [], []
        for own in sets:
            follows = bool(own) and any(jaccard(own, x) >= 0.8 for x in leaders)
            want.append(follows)
            leaders += [own] if own and not follows else []
        assert simhash.followers([np.array(sorted(x), np.uint64) for x in sets], 0.8) == want


def test_segments_grow_with_the_rows():
    assert simhash.segment_plan(1) == simhash.segment_plan(8_000_000) == (2, 16, 8)
    plans = [simhash.segment_plan(10**k) for k in range(1, 13)]
    assert plans == sorted(plans) and all(10**k * (size + 1) / 2**size < 10_000 for k, (_, size, _) in enumerate(plans, 1))
    for words, size, m in set(plans):
        rng = np.random.default_rng(size)
        differ = rng.random((20_000, 64 * words)) < simhash.DIFFER
        meet = np.zeros(len(differ), bool)
        for k in range(m):
            at = (k * 64 * words // m + np.arange(size)) % (64 * words)
            meet |= differ[:, at].sum(1) <= 2
        assert meet.mean() > (0.99 if size == 16 else 0.97), (words, size, m, meet.mean())


@pytest.mark.parametrize("size", [16, 23, 40])
def test_windows(spark, size):
    rng = np.random.default_rng(1)
    for words in (2, 4):
        fps = [tuple(map(int, rng.integers(-(1 << 63), (1 << 63) - 1, words))) for _ in range(20)]
        df = spark.createDataFrame(fps, ", ".join(f"fp{k} long" for k in range(words)))
        for start in (0, 40, 60, 64, 100, 120, 64 * words - 3):
            for *own, w in df.select("*", simhash._window(start, size, words).alias("w")).collect():
                whole = sum((x % (1 << 64)) << (64 * k) for k, x in enumerate(own))
                assert w == ((whole >> start) | (whole << (64 * words - start))) & ((1 << size) - 1)


@pytest.mark.parametrize("plan", [(4, 18, 14), (8, 23, 23)])
def test_longer_fingerprints_find_the_same(spark, monkeypatch, plan):
    monkeypatch.setattr(simhash, "segment_plan", lambda rows: plan)
    test_pairs_just_above_the_limit_are_found(spark)
    test_near_copies_go_and_clean_documents_stay(spark)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bits = lambda: int(rng.integers(0, 1 << 62)) | int(rng.integers(0, 1 << 62)) << 64

    def near(base, k):
        for at in rng.choice(128, k, replace=False):
            base ^= 1 << int(at)
        return base

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [bits() for _ in range(5)]
    words = {near(c, int(rng.integers(0, 9))) for c in centres for _ in range(60)}
    far = {(x & ~((1 << 16) - 1)) | 77 for x in (bits() for _ in range(80))}  # one value of the first segment, far apart
    words = sorted(words | far)
    df = spark.createDataFrame([(signed(w & ((1 << 64) - 1)), signed(w >> 64)) for w in words], "fp0 long, fp1 long")
    df = df.withColumn("node", F.xxhash64("fp0", "fp1"))
    at = {r["node"]: words.index((r["fp0"] % (1 << 64)) | (r["fp1"] % (1 << 64)) << 64) for r in df.collect()}

    def groups(links):
        top = list(range(len(words)))
        for a, b in links:
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    want = groups(sorted((at[r["a"]], at[r["b"]]) for r in simhash.near_links(df, 2, 16, 8).collect()))
    for bucket in (7, 20):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        rows = simhash.near_links(df, 2, 16, 8).collect()
        assert all((words[at[r["a"]]] ^ words[at[r["b"]]]).bit_count() <= 32 for r in rows)
        assert groups(sorted((at[r["a"]], at[r["b"]]) for r in rows)) == want


def test_crowded_buckets_keep_links_of_linked_nodes(spark, monkeypatch):
    """Chains of three, whose ends are linked by the middle only, in one bucket that is dealt into blocks."""
    rng = np.random.default_rng(14)
    rest = lambda: [int(x) for x in rng.integers(0, 1 << 16, 7)]
    chains = []
    for _ in range(40):
        own, some = rest(), [rng.permutation(16) for _ in range(7)]  # four bits of seven segments differ in each step
        step = lambda k: [sum(1 << int(x) for x in p[4 * k : 4 * k + 4]) for p in some]  # noqa: B023, E731
        middle = [x ^ y for x, y in zip(own, step(0), strict=True)]
        chains.append([own, middle, [x ^ y for x, y in zip(middle, step(1), strict=True)]])
    whole = lambda own: sum(x << (16 * k) for k, x in enumerate([77, *own]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [whole(x) for c in chains for x in c]
    df = spark.createDataFrame([(signed(w & ((1 << 64) - 1)), signed(w >> 64)) for w in words], "fp0 long, fp1 long").withColumn("node", F.xxhash64("fp0", "fp1"))
    at = {r["node"]: words.index((r["fp0"] % (1 << 64)) | (r["fp1"] % (1 << 64)) << 64) for r in df.collect()}
    monkeypatch.setattr(simhash, "BUCKET", 30)
    top = list(range(len(words)))
    for r in simhash.near_links(df, 2, 16, 8).collect():
        x, y = top[at[r["a"]]], top[at[r["b"]]]
        top = [min(x, y) if t in (x, y) else t for t in top]
    assert all(top[3 * k] == top[3 * k + 1] == top[3 * k + 2] for k in range(40))


def test_clashing_columns_and_text_ids(clashing):
    rows = set(map(tuple, clashing.collect()))
    kept = simhash.drop_near(clashing)
    assert kept.columns == clashing.columns and set(map(tuple, kept.collect())) <= rows
    assert {r["doc_id"] for r in kept.collect()} >= {None, "id3", "id4", "id5", "id6", "id7", "id8"}
    assert {r["component_id"] for r in simhash.simhash_components(clashing).collect() if r["doc_id"] == "id2"} == {"id1"}


def test_drop_odd_documents(odd, none):
    kept = simhash.drop_near(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, 4, 5, None, 6, 7, 8}
    assert simhash.drop_near(none).count() == 0
