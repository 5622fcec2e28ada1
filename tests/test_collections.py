"""Search, duplicates, checklists, photos, changes, sources and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papertrail import dims, schemas
from papertrail.operators import checklist, dedup, metrics, photos, search, vault
from papertrail.sources import readers, sinks
from papertrail.streaming import ingest


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_bm25_prefixes_and_fusion(spark):
    chunks = spark.createDataFrame([(1, 1, "salary slip march"), (2, 2, "salaries and slips"), (3, 3, "passport copy"), (4, 1, "salary")], "chunk_id long, doc_id long, t string")
    index = search.postings(chunks, text=F.col("t"))
    wanted = search.terms_of(spark.createDataFrame([(7, "show my salar sl")], "query_id long, text string"), text=F.col("text"))
    assert rows(wanted.select("term", "exact")) == [("salar", False), ("sl", True)]
    got = search.bm25(index, wanted, k=5).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 2]
    assert {r["doc_id"]: r["hits"] for r in search.keyword_counts(index, wanted).collect()} == {1: 2, 2: 1}
    a = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(7, 2, 1), (7, 3, 2)], "query_id long, doc_id long, rank int")
    fused = search.rrf([a, b]).orderBy("rank").collect()
    assert [r["doc_id"] for r in fused] == [2, 1, 3] and fused[0]["score"] <= 2 / 61


def test_duplicates_by_vector_then_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [1.0, 0.0]), (2, "alpha beta gamma", [0.999, 0.0447]), (3, "other words here", [1.0, 0.0]), (4, "alpha beta", [0.0, 1.0])], "id long, text string, vector array<double>")
    assert [(r["id"], r["dup_of"]) for r in dedup.near_duplicates(docs).collect()] == [(2, 1)]


def test_checklist_rules(spark):
    day = dt.date
    docs = [
        (1, "a", "SALARY_SLIP", day(2026, 9, 1), None, True, 0.9),
        (2, "a", "SALARY_SLIP", day(2026, 9, 20), None, False, 0.9),
        (3, "a", "SALARY_SLIP", day(2026, 6, 1), None, False, 0.9),
        (4, "a", "SALARY_SLIP", day(2026, 5, 31), None, False, 0.9),
        (5, "a", "BANK_STATEMENT", day(2026, 3, 26), None, False, 0.9),
        (6, "a", "HEALTH_INSURANCE", day(2020, 1, 1), day(2026, 9, 27), False, 0.9),
        (7, "a", "HEALTH_INSURANCE", day(2021, 1, 1), day(2026, 9, 26), False, 0.9),
    ]
    df = spark.createDataFrame(docs, "id long, owner string, effective_type string, effective_date date, expiry_on date, confirmed boolean, confidence double")
    items = dims.templates(spark).filter("template in ('home_loan', 'health_insurance_claim')")
    judged = checklist.candidates(items, df, F.lit("2026-09-27").cast("date"))
    verdict = {(r["template"], r["id"]): r["verdict"] for r in judged.collect()}
    assert [verdict["home_loan", i] for i in range(1, 6)] == ["same_month", "found", "found", "too_old", "too_old"]
    assert verdict["health_insurance_claim", 6] == "found" and verdict["health_insurance_claim", 7] == "expired"
    status = {(r["template"], r["position"]): r["status"] for r in checklist.statuses(judged, items, df).collect()}
    assert status["home_loan", 3] == "partial" and status["home_loan", 0] == "missing" and status["health_insurance_claim", 4] == "optional_missing" and status["health_insurance_claim", 0] == "complete"
    assert [r["id"] for r in checklist.pack(judged.filter("template = 'home_loan'")).orderBy("place").collect()] == [2, 3]
    pinned = checklist.candidates(items, df, F.lit("2026-09-27").cast("date"), pinned=spark.createDataFrame([(4,)], "id long"))
    assert pinned.filter("id = 4 and template = 'home_loan'").first()["verdict"] == "found"


def test_reminders(spark):
    df = spark.createDataFrame([(1, dt.date(2026, 10, 5))], "id long, expiry_on date")
    r = checklist.reminders(df, F.lit("2026-09-27 12:00:00").cast("timestamp"))
    assert {x["offset_days"]: x["state"] for x in r.collect()} == {30: "skipped_past", 7: "scheduled", 1: "scheduled"}
    later = checklist.due(r, F.lit("2026-09-28 09:00:00").cast("timestamp"))
    assert {x["offset_days"]: x["state"] for x in later.collect()} == {30: "skipped_past", 7: "fired", 1: "scheduled"}


HOUR = 3_600_000


def test_trips(spark):
    home = [("u", f"h{d}", d * 24 * HOUR, 17.0, 78.0) for d in range(5)]
    away = [("u", f"a{i}", 200 * HOUR + i * 36 * HOUR, 15.0, 74.0) for i in range(3)]
    late = [("u", f"b{i}", 400 * HOUR + i * HOUR, 15.0, 74.0) for i in range(2)]
    df = spark.createDataFrame([*home, *away, *late, ("u", "zero", 201 * HOUR, 0.0, 0.0)], "user_id string, uri string, taken_at long, lat double, lon double")
    assert rows(photos.trips(df).select("uri", "trip_id")) == [(f"a{i}", 200 * HOUR) for i in range(3)]
    assert photos.trips(df.filter("uri like 'h%'")).count() == 0
    s = photos.trip_summaries(photos.trips(df).withColumn("place", F.when(F.col("uri") != "a0", "Goa"))).first()
    assert (s["photos"], s["place"]) == (3, "Goa")


def test_places(spark):
    points = spark.createDataFrame([(1, 10.99, 77.0), (2, 0.0, 0.0), (3, 50.0, 50.0)], "id long, lat double, lon double")
    places = spark.createDataFrame([("Village", 10.99, 77.01, 0), ("City", 11.05, 77.0, 1_000_000)], "name string, lat double, lon double, population long")
    assert [(r["id"], r["place"]) for r in photos.nearest_places(points, places).collect()] == [(1, "City")]


def decided(spark, probs, faces=None, saved=False, kind="PAN", path="DCIM/x.jpg"):
    p = spark.createDataFrame([(1, c, float(v)) for c, v in probs.items()], "id long, category string, p double")
    photo = spark.createDataFrame([(1, saved, kind, 0.7, path, faces)], "id long, saved boolean, saved_type string, saved_confidence double, path string, faces int")
    r = photos.decide(photo, p).first()
    return r["category"], round(r["confidence"], 4)


def test_photo_ladder(spark):
    assert decided(spark, {"food": 0.7, "selfie": 0.3}) == ("food", 0.7)
    assert decided(spark, {"selfie": 0.5, "people": 0.2, "food": 0.3}, faces=0) == ("food", 1.0)
    assert decided(spark, {"selfie": 0.5, "people": 0.2, "food": 0.3}, faces=3) == ("people", 0.7)
    assert decided(spark, {"selfie": 0.5, "people": 0.2, "food": 0.3}, faces=1) == ("selfie", 0.7)
    assert decided(spark, {"documents": 0.9, "food": 0.1}) == ("other", 0.9)
    assert decided(spark, {"places": 0.35, "food": 0.33, "other": 0.32}) == ("other", 0.35)
    assert decided(spark, {"food": 1.0}, saved=True) == ("documents", 1.0)
    assert decided(spark, {"food": 1.0}, saved=True, kind="UTILITY_BILL") == ("bills", 0.7)
    assert decided(spark, {"food": 1.0}, path="a/Screenshots/b") == ("screenshot", 1.0)
    assert decided(spark, {}) == ("other", 0.0)


def test_titles_and_effective_types(spark):
    rows_ = [(1, "PAN", 0.79, False, "PAN card · Asha"), (2, "pan", 0.8, False, "PAN card · Asha"), (3, "zzz", 0.1, True, "x"), (4, "PAN", 0.1, True, "PAN card")]
    df = spark.createDataFrame(rows_, "id long, doc_type string, doc_type_confidence double, is_user_confirmed boolean, title_en string")
    df = df.withColumns({"issued_on": F.lit(None).cast("date"), "captured_at": F.lit("2026-01-01").cast("timestamp"), "expiry_on": F.lit("2026-01-01").cast("date")})
    got = vault.with_derived(df, F.lit("2026-01-02").cast("date")).orderBy("id").collect()
    assert [(r["effective_type"], r["display_title"]) for r in got] == [("OTHER_DOCUMENT", "Asha"), ("PAN", "PAN card · Asha"), ("OTHER_DOCUMENT", "x"), ("PAN", "PAN card")]
    assert all(r["expired"] for r in got)


def test_changes(spark):
    kept = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "e"), (3, "d")], "id long, v string")
    assert rows(vault.insert_ignore(kept, new, ["id"], [F.col("v")])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(vault.upsert(kept, new.filter("v <> 'e'"), ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(vault.latest_per_key(new, ["id"], [F.col("v")])) == [(2, "c"), (3, "e")]
    left = vault.delete_cascade(kept.filter("id = 1"), {"a": (kept, "id"), "b": (new.withColumnRenamed("id", "doc_id"), "doc_id")})
    assert rows(left["a"]) == [(2, "b")] and left["b"].count() == 3


def test_metrics(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(600)], "series string, n long, ms double")
    r = metrics.latency(df, series="series", value="ms", newest=[F.desc("n")]).first()
    assert (r["n"], r["p50"], r["p95"], r["last"]) == (500, 349.0, 574.0, 599.0)


def test_dictionaries(spark, tmp_path):
    (tmp_path / "places.tsv").write_text("# c\n\nGoa\t15.5\t73.8\t1000\nBad\t1\nOdd\t1.0\t2.0\tx\n")
    assert rows(readers.places(spark, str(tmp_path / "places.tsv"))) == [("Goa", 15.5, 73.8, 1000), ("Odd", 1.0, 2.0, 0)]
    (tmp_path / "t.json").write_text('{"templates": [{"id": "x", "title_en": "X", "items": [{"doc_type": "PAN"}, {"doc_type": "SALARY_SLIP", "count": 3, "recency": {"rule": "distinct_months", "months": 3}}]}]}')
    assert rows(readers.checklist_templates(spark, str(tmp_path / "t.json"))) == [("x", 0, "PAN", 1, False, None, 0), ("x", 1, "SALARY_SLIP", 3, False, "distinct_months", 3)]
    kv = spark.createDataFrame([("relations", "father=Ravi\nself=Asha"), ("ids", "3, 5,x")], "key string, value string")
    assert rows(readers.kv_map(kv, "relations")) == [("father", "Ravi"), ("self", "Asha")] and rows(readers.kv_ids(kv, "ids")) == [(3,), (5,)]


def test_pages_of_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"p1|p2")), ("b", bytearray(b"!"))], "path string, content binary")

    def render(content):
        if content == b"!":
            raise PermissionError("encrypted")
        return content.decode().split("|")

    got = [(r["path"], r["page"], r["text"], r["error"]) for r in readers.pages_of(files, render).orderBy("path", "page").collect()]
    assert got == [("a", 0, "p1", None), ("a", 1, "p2", None), ("b", None, None, "PermissionError")]


def test_batches_count_once(spark, tmp_path):
    kv = spark.createDataFrame([("a", "1")], schemas.TABLES["kv"])
    for _ in range(2):
        sinks.write_batch({"kv": kv}, str(tmp_path), 0)
    assert sinks.read_table(spark, str(tmp_path), "kv").count() == 1 and sinks.abandoned(spark, str(tmp_path), "kv").count() == 1
    old = spark.createDataFrame([("u", "food")], "uri string, category string")
    assert schemas.conformed(old, "photos").first()["place"] is None


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    path, ids = str(tmp_path), "id long"
    tables = lambda lo, hi: {"a": spark.range(lo, hi).toDF("id"), "b": spark.range(lo, hi).toDF("id")}
    read = lambda: [sorted(r["id"] for r in sinks.read_table(spark, path, t, ids).collect()) for t in ("a", "b")]
    sinks.write_batch(tables(0, 2), path, 0)
    broken = tables(2, 5) | {"b": spark.range(2, 5).select(F.when(F.col("id") < 9, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long").alias("id"))}
    with pytest.raises(Exception, match="stop"):
        sinks.write_batch(broken, path, 1)  # the first table is written, the second is not
    assert read() == [[0, 1], [0, 1]]
    sinks.write_batch(tables(2, 4), path, 1)
    assert read() == [[0, 1, 2, 3]] * 2
    sinks.write_batch(tables(7, 8), path, 0)  # again, with other rows
    assert read() == [[2, 3, 7]] * 2 and sinks.abandoned(spark, path, "a").count() == 2


def test_stream(spark, tmp_path):
    items = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id as string) uri", "id generation")
    process = lambda b: b.selectExpr("uri", "generation", "if(generation % 3 = 0, 'failed', 'done') status", "cast(null as string) error")
    for lo, hi in ((0, 6), (3, 9)):
        items(lo, hi).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.items(spark, str(tmp_path / "in"), "uri string, generation long")
        ingest.run(stream, process, str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    states = ingest.states(spark, str(tmp_path / "state"))
    assert rows(ingest.status_counts(states)) == [("done", 6), ("failed", 3)]
    assert ingest.unfiled(states, spark.createDataFrame([("1",)], "uri string")).count() == 5
