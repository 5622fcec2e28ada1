import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papertrail.operators import chunks, classify, dates, entities, owners, pages

TODAY = dt.date(2026, 9, 27)


def found(line):
    return [(f.date.isoformat(), f.precision) for f in dates.dates_in(line, 0, TODAY)]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("12 March 2026", [("2026-03-12", "day")]),
        ("March 5th, 2026", [("2026-03-05", "day")]),
        ("03/04/2026", [("2026-04-03", "day")]),
        ("03/25/2026", [("2026-03-25", "day")]),
        ("1.2.99", [("1999-02-01", "day")]),
        ("2026-01-31", [("2026-01-31", "day")]),
        ("Mar 2026", [("2026-03-01", "month")]),
        ("03/2026", [("2026-03-01", "month")]),
        ("१२ मार्च २०२५", [("2025-03-12", "day")]),
        ("12 మార్చి 2025", [("2025-03-12", "day")]),
        ("31/02/2026 10.20.30.40 1850-01-01", []),
        ("no date", []),
    ],
)
def test_dates(line, want):
    assert found(line) == want


def test_ambiguity():
    a, b = dates.dates_in("03/04/2026 03/25/2026", 0, TODAY)
    assert a.ambiguous and not a.month_first and b.month_first and not b.ambiguous


EXPIRIES = [
    ("Policy period 01/04/2025 to 31/03/2026", "HEALTH_INSURANCE", "2026-03-31", "rule", []),
    ("Date of issue 01/04/2015 valid till 31/03/2035", "PASSPORT", "2035-03-31", "rule", []),
    ("Due date\n15/10/2026", "UTILITY_BILL", "2026-10-15", "rule", []),
    ("15/10/2026\nlast date", "UTILITY_BILL", "2026-10-15", "rule", []),
    ("Due date 01/01/2026\n15/10/2026", "UTILITY_BILL", "2026-01-01", "rule", []),
    ("Date of issue\n15/10/2026", "UTILITY_BILL", None, None, ["2026-10-15"]),
    ("Valid till 01/01/2027", "SALARY_SLIP", None, None, []),
    ("valid till 01/01/2027\nrenewal 02/02/2025", "WARRANTY", "2027-01-01", "fallback", ["2027-01-01", "2025-02-02"]),
    ("valid till 01/01/2020\nrenewal 02/02/2025", "WARRANTY", "2025-02-02", "fallback", ["2020-01-01", "2025-02-02"]),
    ("valid till 01/01/2027 or 01/01/2028", "WARRANTY", "2027-01-01", "rule", []),
    ("01/01/2027", "WARRANTY", None, None, ["2027-01-01"]),
    ("01/04/2025 to 31/03/2026", None, None, None, []),
    ("Cover\n01/04/2025 to 31/03/2026", None, "2026-03-31", "rule", []),
    ("01/04/2025 - 31/03/2026", "RENT_AGREEMENT", "2026-03-31", "rule", []),
    ("31/03/2026 - 01/04/2025", "RENT_AGREEMENT", None, None, ["2026-03-31", "2025-04-01"]),
    ("01/01/2025 to 01/02/2025 to 01/03/2025", "RENT_AGREEMENT", "2025-03-01", "rule", []),
    ("exp. Mar 2027", "PASSPORT", "2027-03-31", "rule", []),
    ("expert 01/01/2027", "PASSPORT", None, None, ["2027-01-01"]),
    ("वैधता 31/03/2027", "PASSPORT", "2027-03-31", "rule", []),
    ("गाड़ी ३१/०३/२०२७ तक वैध", "PASSPORT", None, None, ["2027-03-31"]),
    ("గడువు 31/03/2027", "PASSPORT", "2027-03-31", "rule", []),
]


def test_expiry(spark):
    df = spark.createDataFrame([(n, kind, text) for n, (text, kind, *_) in enumerate(EXPIRIES)], "id long, doc_type string, text string").repartition(3)
    iso = lambda d: d and d.isoformat()
    got = {r["id"]: (iso(r["expiry_on"]), r["expiry_source"], [iso(d) for d in r["candidates"]]) for r in dates.pick(df, TODAY).collect()}
    for n, (text, kind, *want) in enumerate(EXPIRIES):
        assert got[n] == tuple(want), (text, kind)


def test_issue_date(spark):
    texts = [
        ("Salary for the month of\nJune 2026\nprinted 05/07/2026", "SALARY_SLIP", dt.date(2026, 6, 1)),
        ("June 2026\nprinted 05/07/2026", "SALARY_SLIP", dt.date(2026, 6, 1)),
        ("June 2026\nprinted 05/07/2026", "PAN", dt.date(2026, 7, 5)),
        ("01/01/2020 and 01/01/2030", "PAN", dt.date(2020, 1, 1)),
        ("dated 01/01/2019, again 01/01/2021", "PAN", dt.date(2021, 1, 1)),
        ("valid till 01/01/2025 of 01/01/2020", "WARRANTY", dt.date(2020, 1, 1)),
        ("", "PAN", None),
        (None, "PAN", None),
    ]
    df = spark.createDataFrame([(n, kind, text) for n, (text, kind, _) in enumerate(texts)], "id long, doc_type string, text string")
    got = {r["id"]: r["issued_on"] for r in dates.pick(df, TODAY).collect()}
    assert [got[n] for n in range(len(texts))] == [want for *_, want in texts]


def test_pick_over_table(spark):
    df = spark.createDataFrame([(1, "HEALTH_INSURANCE", "issued 01/01/2026\nvalid till 31/12/2026"), (2, "PAN", None)], "id long, doc_type string, text string")
    got = {r["id"]: (r["expiry_on"], r["issued_on"]) for r in dates.pick(df, TODAY).collect()}
    assert got == {1: (dt.date(2026, 12, 31), dt.date(2026, 1, 1)), 2: (None, None)}
    assert dates.extract(df, TODAY).count() == 2


def entities_in(spark, text):
    rows = entities.extract(spark.createDataFrame([(1, text)], "id long, t string"), text=F.col("t")).collect()
    return sorted(rows, key=lambda r: r["start"])


def test_entities(spark):
    text = "ABCDE1234F Rs. 1,23,456.50 total 5000 balance: 700 AP 09 AB 1234 22 BH 1234 AA policy no: AB/12345-X SBIN0001234 x.y1@abdm"
    got = {(e["kind"], e["value"]) for e in entities_in(spark, text)}
    assert got == {("pan", "ABCDE1234F"), ("amount", "123456.50"), ("amount", "5000"), ("amount", "700"), ("vehicle_no", "AP09AB1234"), ("vehicle_no", "22BH1234AA"), ("policy_no", "AB/12345-X"), ("ifsc", "SBIN0001234"), ("abha", "x.y1@abdm")}
    kinds = lambda t: [(e["kind"], e["masked"]) for e in entities_in(spark, t)]
    assert kinds("2341 2341 2346") == [("aadhaar", "XXXX XXXX 2346")]
    assert kinds("4539578763621486") == [] and kinds("2341 2341 2345") == []
    assert kinds("+91 98765 43210") == [("phone", "XXXXXX3210")] and kinds("12-3456-7890-1234") == [("abha", "XX-XXXX-XXXX-1234")]
    assert kinds("२३४१ २३४१ २३४६") == [("aadhaar", "XXXX XXXX 2346")]


def test_places_of_entities(spark):
    text = "बैलेंस: x policy no: AB/12345-X; total 5000, Rs. 5000 और +91 98765 43210, 2341 2341 2346"
    assert all(text[e["start"] : e["end"]].replace(" ", "").replace("+91", "") == e["value"] for e in entities_in(spark, text))
    assert [e["kind"] for e in entities_in(spark, text)] == ["policy_no", "amount", "amount", "phone", "aadhaar"]
    assert [e["kind"] for e in entities_in(spark, "total Rs 500 total: 900")] == ["amount", "amount"]


def test_entity_table(spark):
    df = spark.createDataFrame([(1, "Rs 500 and Rs 90"), (2, None), (3, "")], "id long, t string")
    rows = entities.extract(df, text=F.col("t"))
    assert [(r["id"], r["amount"]) for r in entities.largest_amount(rows).collect()] == [(1, "500")]


OWNER_CASES = [
    ("भारत सरकार\nGovernment of India\nవెంకట రావు\nVenkata Rao\nDOB: 01/01/1985\nMale", "AADHAAR", "Venkata Rao"),
    ("Address:\nS/O Ramesh Babu, 2-45\nMain Road\nOngole\nPrakasam, Andhra Pradesh\nPin code: 523001\nDOB: 01/01/1985", "AADHAAR", None),
    ("Employee Name: MR. RAVI kumar Designation: x\nNet Pay: 45000", "SALARY_SLIP", "Ravi Kumar"),
    ("Father's Name: Ram Das\nName: Sita Devi", "PAN", "Sita Devi"),
    ("Name\nAsha Rao", "PASSPORT", "Asha Rao"),
    ("Customer Name: David Robinson", "RECEIPT_INVOICE", None),
    ("nothing here", "PAN", None),
    (None, "PAN", None),
]


@pytest.mark.parametrize(("text", "kind", "want"), OWNER_CASES)
def test_owner(spark, text, kind, want):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(owners.owner(F.col("t"), F.col("k")).alias("o")).first()["o"] == want


def test_owner_relations(spark):
    known = F.create_map(F.lit("father"), F.lit("Ravi"), F.lit("self"), F.lit("Asha"))
    said = ["my father's aadhaar", "my pan", "mother's pan", "the sonnet"]
    df = spark.createDataFrame([(s,) for s in said], "q string").select(owners.relation_of(F.col("q"), known).alias("x"))
    assert [r["x"] for r in df.collect()] == ["Ravi", "Asha", None, None]
    assert owners.place_in("photos from ongol", ["Goa", "Ongole"]) == "Ongole" and owners.place_in("a goat", ["Goat"]) == "Goat" and owners.place_in("run", ["Un"]) is None


def classified(spark, text, kinds=(), expected=None, hints=None):
    df = spark.createDataFrame([(1, text, list(kinds))], "id long, t string, kinds array<string>")
    h = None if hints is None else F.create_map(*(F.lit(x) for kv in hints.items() for x in kv))
    r = classify.classify(df, text=F.col("t"), kinds=F.col("kinds"), hints=h, expected=None if expected is None else F.lit(expected)).first()
    return r["doc_type"], round(r["doc_type_confidence"], 4), r["doc_type_source"], r["needs_model"]


def test_classification(spark):
    assert classified(spark, "Unique Identification Authority aadhaar", ["aadhaar"]) == ("AADHAAR", 0.97, "rule", False)
    assert classified(spark, "Income Tax Department PAN", ["pan"]) == ("PAN", 0.97, "rule", False)
    assert classified(spark, "Form 16, assessment year, TDS, Income Tax Department PAN", ["pan"])[0] == "ITR_FORM16"
    assert classified(spark, "pay slip: net pay, earnings, deductions") == ("SALARY_SLIP", 0.92, "rule", False)
    assert classified(spark, "P<INDRAO") == ("PASSPORT", 0.97, "rule", False)
    assert classified(spark, "nothing") == ("OTHER_DOCUMENT", 0.3, "rule", True)
    assert classified(spark, "gross pay earnings", hints={"a salary slip": 0.9})[:1] + classified(spark, "gross pay earnings", hints={"a salary slip": 0.9})[2:] == ("SALARY_SLIP", "image", False)
    assert classified(spark, "policy no", expected="LIFE_INSURANCE")[0] == "LIFE_INSURANCE"
    assert classified(spark, "") == ("OTHER_DOCUMENT", 0.3, "rule", True)


def test_word_pieces_and_chunks(spark):
    vocabulary = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", ",", "日", "a", "b"])}
    model = chunks.WordPiece(vocabulary)
    assert model.tokens("Unaffable, CAFÉ 日x") == ["un", "##aff", "##able", ",", "cafe", "日", "[UNK]"]
    assert model.encode("a " * 200) == [1, *[9] * 126, 2] and model.pieces("x" * 101) == ["[UNK]"] and model.encode("") == [1, 2]
    got = chunks.chunk("a b " * 100, model.count)
    assert [n for _, n in got] == [110, 110] and got[1][0].split()[0] == "a"
    assert chunks.fit("a b unaffable b", 4, model.count) == "a b"
    df = spark.createDataFrame([(1, "x" * 900, "facts line", "PAN card"), (2, None, None, None)], "id long, text string, facts string, label string")
    rows = chunks.document_chunks(df, facts="facts", label="label").orderBy("id", "chunk_ix").collect()
    assert [len(r["text"]) for r in rows] == [10, 410, 410, 110]


def slow_chunks(text, count, most, overlap):
    """Word by word."""
    words, out, start = text.split(), [], 0
    while start < len(words):
        end, total = start, 0
        while end < len(words) and total + count(words[end]) <= most:
            total += count(words[end])
            end += 1
        if end == start:
            end, total = start + 1, count(words[start])
        if total:
            out.append((" ".join(words[start:end]), total))
        if end == len(words):
            return out
        shared, start_at = 0, end
        while start_at > start + 1 and shared + count(words[start_at - 1]) <= overlap:
            start_at -= 1
            shared += count(words[start_at])
        start = start_at
    return out


@given(st.lists(st.integers(0, 9), max_size=80), st.integers(1, 12), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_borders_of_chunks(sizes, most, overlap):
    text = " ".join(f"{n}w{i}" for i, n in enumerate(sizes))
    count = lambda w: int(w.split("w")[0])
    assert chunks.chunk(text, count, most, overlap) == slow_chunks(text, count, most, overlap)


def words_on(spark, *words):
    rows = [(1, i, t, *(map(float, box) if box else [None] * 4)) for i, (t, *box) in enumerate(words)]
    return spark.createDataFrame(rows, "page_id long, word int, text string, left double, top double, right double, bottom double")


def test_covers(spark):
    split = words_on(spark, ("2341", 0, 0, 10, 10), ("2341", 11, 1, 20, 11), ("2346", 21, 0, 30, 10), ("other", 0, 30, 9, 40))
    assert [(r["word"], r["left"], r["bottom"]) for r in pages.covers(split).orderBy("word").collect()] == [(0, -1.5, 12.0), (1, 9.5, 13.0)]
    assert pages.mask_plans(split).first().asDict() == {"page_id": 1, "found": 1, "boxed": 1, "complete": True}
    assert pages.covers(words_on(spark, ("234123412345", 0, 0, 9, 9))).count() == 0
    open_ = words_on(spark, ("2341", 0, 0, 10, 10), ("2341",), ("2346", 21, 0, 30, 10))
    assert pages.mask_plans(open_).first().asDict() == {"page_id": 1, "found": 1, "boxed": 0, "complete": False}
    # once in boxes, in another order, and once without: the boxed one doesn't stand for the other
    both = words_on(spark, ("2346", 21, 0, 30, 10), ("2341", 11, 0, 20, 10), ("2341", 0, 0, 10, 10), ("x", 0, 50, 9, 60), ("2341",), ("2341",), ("2346",))
    assert pages.mask_plans(both).first().asDict() == {"page_id": 1, "found": 2, "boxed": 1, "complete": False}
    inside = words_on(spark, ("No:२३४१-2341-2346!", 0, 0, 180, 10))
    assert [(round(r["left"], 6), round(r["right"], 6)) for r in pages.covers(inside).collect()] == [(30 - 1.5, 30 + 90 + 1.5)]


def test_mask_plans_gather_each_page_once(spark):
    """Also of words whose page is not known: its numbers are read as any page's, and without boxes it fails closed."""
    rows = [(None, 1, "2341"), (None, 2, "2341"), (None, 3, "२३४६"), (7, 1, None)]
    words = spark.createDataFrame([(*r, None, None, None, None) for r in rows], "page_id long, word int, text string, left double, top double, right double, bottom double")
    plans = pages.mask_plans(words)
    assert plans._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, plans.collect()), key=str) == [(7, 0, 0, True), (None, 1, 0, False)]


def test_merged_readings(spark):
    schema = "page_id long, line int, text string, confidence double, left double, top double, right double, bottom double"
    line = lambda *rows: spark.createDataFrame([(*r[:4], *map(float, r[4:])) for r in rows], schema)
    first = line((1, 1, "garbled", 0.9, 0, 0, 100, 20), (1, 2, "Name of the person and a good deal more text", 0.9, 0, 30, 100, 50), (2, 1, "x", 0.9, 0, 0, 9, 9), (3, 1, "abc", 0.2, 0, 0, 9, 9))
    other = line((1, 1, "नाम", 0.9, 10, 2, 90, 19), (1, 2, "Latin", 0.9, 0, 30, 100, 50), (4, 1, "नमस्ते", 0.9, 0, 0, 9, 9))
    third = line((2, 1, "a longer reading of the page", 0.9, 0, 0, 9, 9), (3, 1, "ab", 0.9, 0, 0, 9, 9), (5, 1, "only here", 0.9, 0, 0, 9, 9))
    got = {r["page_id"]: (r["engine"], r["text"]) for r in pages.readings(first, other, third).collect()}
    assert got == {1: ("merged", "नाम\nName of the person and a good deal more text"), 2: ("merged+fallback", "a longer reading of the page"), 3: ("merged", "abc"), 4: ("merged", "नमस्ते"), 5: ("fallback", "only here")}
