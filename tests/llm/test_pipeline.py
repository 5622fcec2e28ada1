import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from papertrail.llm.tokens import WordEncoder, vocabulary_path
from tests.llm.conftest import ROWS, SF
from tests.llm.test_langid_decontam import slow_contained
from tests.llm.test_simhash import jaccard, shingles


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        steps[name] = ([tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()])
    before, after = steps["language_id"]
    assert {r[0] for r in before} - {r[0] for r in after} == {r[0] for r in before if not any(c.isalpha() for c in r[1] or "")}
    before, after = steps["exact_dedup"]
    last = defaultdict(int)
    for r in before:
        last[r[1]] = max(last[r[1]], r[0])
    assert sorted(r[0] for r in after) == sorted(last.values())
    before, after = steps["near_dedup"]
    sets = {r[0]: shingles(r[1]) for r in before}
    kept = {r[0] for r in after}
    assert all(max(jaccard(sets[i], sets[j]) for j in kept) >= 0.8 for i in set(sets) - kept)
    before, after = steps["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {int(x[0]) for x in slow_contained([r[:2] for r in before], items)}
    assert {r[0] for r in after} == {r[0] for r in before} - dirty
    encoder = WordEncoder(vocabulary_path("word_bpe_49k.json"))
    before, after = steps["packing"]
    for r in before:
        ids = [*encoder.library.encode(r[1], add_special_tokens=False).ids, 1]
        own = sorted(x for x in after if x[0] == r[0])
        at = 0
        for x in own:
            part = np.array(ids[at : at + x[2]], "<u4").tobytes()
            assert x[1] == at and zlib.crc32(part) == x[3] and x[4] == len(ids)
            at += x[2]
        assert at == len(ids)


def test_run_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict()) and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_stages_take_empty_and_odd_tables(spark, odd, none):
    for df in (none, odd):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
            df = spark.createDataFrame(df.collect(), df.schema)
        assert df.count() >= 0
