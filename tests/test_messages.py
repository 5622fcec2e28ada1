import datetime as dt

import pytest
from pyspark.sql import functions as F

from papertrail.lexicon import Lexicon, parse
from papertrail.operators import answers, intents

TODAY = dt.date(2026, 9, 27)
RULES = intents.RuleParser(Lexicon())


def ask(q):
    return RULES.parse(q, TODAY)


CHAT = ["hi", "Hello!", "hey there", "good morning", "namaste", "thanks", "thank you so much", "ok", "what can you do", "bye", "नमस्ते", "ధన్యవాదాలు", "kaise ho", "🙂👍", "   ", "what's the weather today", "write python code", "is my data safe", "can you see my photos", "yes", "how do I apply"]
EVAL = [
    ("show my salary slips", "SALARY_SLIP"),
    ("when does my health insurance expire", "HEALTH_INSURANCE"),
    ("car insurance policy", "VEHICLE_INSURANCE"),
    ("latest blood test report", "MEDICAL_REPORT"),
    ("hospital bill from my last admission", "HOSPITAL_BILL"),
    ("bank statement for last month", "BANK_STATEMENT"),
    ("నా ఆధార్ కార్డ్ చూపించు", "AADHAAR"),
    ("కరెంట్ బిల్లు ఎంత", "UTILITY_BILL"),
    ("naa health insurance ekkada undi", "HEALTH_INSURANCE"),
    ("मेरा आधार कार्ड दिखाओ", "AADHAAR"),
    ("गाड़ी का बीमा", "VEHICLE_INSURANCE"),
    ("ऑफर लेटर या नौकरी का पत्र", "EMPLOYMENT_LETTER"),
]


@pytest.mark.parametrize("q", CHAT)
def test_small_talk(q):
    assert ask(q).kind == "chat"


@pytest.mark.parametrize(("q", "kind"), EVAL)
def test_types_in_three_languages(q, kind):
    assert kind in ask(q).doc_types


def test_kinds():
    assert ask("hi, show my aadhaar").kind == "find" and ask("what is my car insurance policy number").kind == "question"
    assert ask("thanks, anything expiring soon?").kind == "reminders" and ask("Home loan ki documents ready cheyyi").template == "home_loan"
    assert ask("email my expired pan").kind == "find" and ask("how many salary slips do I have").kind == "find"


def test_negation():
    i = ask("show all documents except aadhaar")
    assert (i.doc_types, i.exclude_types, i.list_all) == ([], ["AADHAAR"], True)
    i = ask("not my pan, my aadhaar")
    assert (i.doc_types, i.exclude_types) == (["AADHAAR"], ["PAN"])
    assert ask("this is not the salary slip").doc_types == ["SALARY_SLIP"]
    assert ask("aadhaar kakunda all documents").exclude_types == ["AADHAAR"]


def test_actions_order_overview():
    assert [ask(q).action for q in ("delete my aadhaar", "send my pan", "rename my pan", "how to apply for passport", "my pan")] == ["delete", "share", "edit", "advice", None]
    assert ask("oldest salary slip").order == "oldest" and ask("latest salary slip").order == "latest"
    assert all(ask(q).list_all for q in ("what documents do I have", "show everything", "my documents"))


@pytest.mark.parametrize(
    ("q", "first", "last"),
    [
        ("salary slip from march", "2026-03-01", "2026-03-31"),
        ("november salary slip", "2025-11-01", "2025-11-30"),
        ("salary slip march 2025", "2025-03-01", "2025-03-31"),
        ("selfies from last month", "2026-08-01", "2026-08-31"),
        ("bills in the last 3 months", "2026-06-27", "2026-09-27"),
        ("bills this year", "2026-01-01", "2026-09-27"),
        ("bill of 05/06/2026", "2026-06-05", "2026-06-05"),
        ("may I see my pan", None, None),
        ("jan dhan passbook", None, None),
    ],
)
def test_periods(q, first, last):
    i = ask(q)
    assert (i.date_from and i.date_from.isoformat(), i.date_to and i.date_to.isoformat()) == (first, last)


def test_photos():
    assert {q: ask(q).photo_category for q in ("show my selfies", "photos with friends", "food pics", "మ ట్రిప్ ఫోటోలు")} == {"show my selfies": "selfie", "photos with friends": "people", "food pics": "food", "మ ట్రిప్ ఫోటోలు": "places"}
    assert ask("restaurant bill from my goa trip").doc_types == ["RECEIPT_INVOICE"] and ask("family health insurance").kind == "find"


def test_corrections_and_cues():
    assert all(map(RULES.is_correction, ["this is not the salary slip", "wrong one", "none of these", "galat hai", "ఇది తప్పు", "no", "nahi"]))
    assert not any(map(RULES.is_correction, ["show my salary slip", "I have no passport", "is it correct?"]))
    assert not RULES.cue("my mother's aadhaar").older and not RULES.cue("policy holder name").older
    c = RULES.cue("when does it expire?")
    assert c.reference and c.attribute and RULES.cue("share it").action == "share"
    assert [RULES.cue(q).ordinal for q in ("the first one", "the second one", "the third one", "the last one", "it")] == [0, 1, 2, -1, None]
    assert RULES.cue("and my wife's?").owner_switch and RULES.cue("sai's?").owner_switch and RULES.cue("show another one").older


def test_languages():
    assert [RULES.language(q) for q in ("hello", "naa bill chupinchu", "mera bill dikhao", "నా బిల్లు", "मेरा बिल")] == ["en", "te", "hi", "te", "hi"]


def check(**raw):
    return intents.validate(raw, "msg", "en")


def test_validation():
    i = check(intent="find", doc_types=["aadhaar", "PAN", "zzz"], exclude_doc_types=["PAN"], action="share", order="oldest", follow_up=True, date_from="2026-02-01", date_to="2026-01-01")
    assert (i.doc_types, i.exclude_types, i.action, i.order, i.follow_up, i.dropped) == (["AADHAAR"], ["PAN"], "share", "oldest", True, ["zzz"])
    assert (i.date_from, i.date_to) == (dt.date(2026, 1, 1), dt.date(2026, 2, 1))
    assert check(intent="photos").kind == "find" and check(intent="photos", photo_category="food").photo_category == "food"
    assert check(intent="pack").kind == "find" and check(intent="pack", task_template="home_loan").kind == "pack"
    assert check(intent="chat", doc_types=["PAN"]).kind == "find" and check(intent="chat", query_en="null").query_en == "msg"
    assert check(intent="find", exclude_doc_types=["AADHAAR"]).list_all and check(intent="find", date_from="x").date_from is None
    with pytest.raises(ValueError, match="intent"):
        check(intent="other")


def test_follow_ups(spark):
    said = ["when does it expire?", "share it", "the second one", "and my wife's?", "another one", "that one", "show my passport", "ok", "when does this pan card expire"]
    df = intents.parse(spark.createDataFrame([(i, q) for i, q in enumerate(said)], "n long, text string"), Lexicon(), TODAY)
    shown = F.array(*(F.struct(F.lit("PAN").alias("doc_type"), F.lit(x).alias("owner_name")) for x in ("a", "b")))
    got = df.select("n", intents.follow_up(F.col("cue"), F.col("intent"), shown, F.array(F.lit("PAN"))).alias("p"), intents.picked_document(F.col("cue"), shown)["owner_name"].alias("d")).orderBy("n").collect()
    assert [r["p"] for r in got] == ["ask", "show", "show", "again", "again", "show", None, None, "ask"]
    assert got[2]["d"] == "b"


def test_lexicon_from_json():
    lex = parse('{"doc_types": {"PAN": ["zzz"]}, "else": 1}')
    assert intents.RuleParser(lex).parse("zzz", TODAY).doc_types == ["PAN"]


def test_answers(spark):
    def say(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    types = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    none = F.lit(None).cast("string")
    assert say(answers.summary(types("PAN"), types("PAN", "PAN"), F.lit(5), types("a", "b"), F.lit("oldest"), F.lit("delete"))) == "PAN card: 5 saved, for a, b. Showing the oldest 2. Deleting is done on the document's own page."
    assert say(answers.summary(types("PAN"), types("PAN"), F.lit(1), types(), F.lit("latest"), none)) == "Here is your PAN card."
    assert say(answers.summary(types(), types("PAN", "TICKET"), F.lit(2), types(), F.lit("latest"), none)) == "Found 2 documents: PAN card, Ticket."
    assert say(answers.no_match(types("PAN"), none, F.lit(True))) == "There is no other PAN card saved."
    assert say(answers.no_match(types(), none, F.lit(False))) == "Which document do you mean?"
    assert say(answers.chat_reply(F.lit("bye"))) == "Goodbye."
    kept, dropped = answers.citations(F.array(F.lit(1), F.lit(9), F.lit(1)), F.array(F.lit(1), F.lit(2)))
    assert (say(kept), say(dropped)) == ([1], [9])
    counts = F.array(F.struct(F.lit("PAN").alias("doc_type"), F.lit(2).alias("n")))
    assert say(answers.overview(F.lit(3), counts, types("TICKET"))) == "You have 3 documents: PAN card 2. Left out: Ticket."


def test_routes(spark):
    from papertrail.operators import router

    said = [("photos from ongole", True), ("wrong one", True), ("share it", True), ("show my pan", True), ("show my pan", False), ("is my passport valid", False), ("hi", True), ("home loan documents ready", False), ("another one", True)]
    df = intents.parse(spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(said)], "n long, text string, context boolean"), Lexicon(), TODAY)
    shown = F.array(F.struct(F.lit("PAN").alias("doc_type"), F.lit("a").alias("owner_name")))
    df = df.withColumns({"place": router.place_named(F.col("text"), ["Ongole"]), "shown": F.when(F.col("context"), shown), "context_types": F.when(F.col("context"), F.array(F.lit("PAN")))})
    got = [(r["branch"], r["exclude_shown"], r["limit"]) for r in router.route(df).orderBy("n").collect()]
    assert got == [("photos", False, 60), ("find", True, 6), ("follow_up_show", False, 6), ("find", True, 6), ("find", False, 6), ("find", False, 6), ("chat", False, 6), ("pack", False, 6), ("follow_up_again", True, 6)]


def test_history(spark):
    from papertrail.operators import history

    turns = [(1, i, f"q{i}", "find", "t", [i, 99], [i], None, ["PAN"]) for i in range(60)] + [(2, 100, "q", "chat", "t", None, None, None, None)]
    df = spark.createDataFrame(turns, "chat_id long, at long, query string, kind string, text string, doc_ids array<long>, cited_ids array<long>, template_id string, doc_types array<string>")
    kept = history.saved(df)
    assert [r["chat_id"] for r in kept.orderBy(F.desc("updated_at")).collect()] == [2, 1]
    back = history.restored(kept, spark.range(55).toDF("id")).orderBy("chat_id", "turn").collect()
    assert len(back) == 51 and back[0]["query"] == "q10" and back[0]["doc_ids"] == [10] and back[49]["doc_ids"] == [] and back[50]["doc_ids"] == []
    masked = spark.range(1).select(history.fully_masked(F.array(F.lit("1"), F.lit("2")), F.array(F.lit("2"))).alias("x")).first()["x"]
    assert masked is False
