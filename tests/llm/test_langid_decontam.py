import math
import zlib

import pytest
from pyspark.sql import functions as F

from papertrail.llm import decontam, langid
from papertrail.llm.queries import fold, op3_language_id
from tests.llm.conftest import ROWS, SF


def test_automaton_knows_all_substrings_and_no_others():
    text = [1, 2, 1, 1, 2, 3, 1, 2, 1]
    to = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(9) for j in range(i + 1, 10)}
    todo = [((), 1)]
    seen = set()
    while todo:
        run, s = todo.pop()
        for c, t in to[s].items():
            seen.add((*run, c))
            todo.append(((*run, c), t))
    assert seen == inside


def slow_phrases(text, reference):
    """(phrases, unknown characters) of the windows of a text, by longest matches; an unknown character is a phrase."""
    n = unknown = 0
    text = text.lower()
    for a in range(0, len(text), langid.WINDOW):
        part, i = text[a : a + langid.WINDOW], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in reference:
                k += 1
            n, unknown, i = n + 1, unknown + (part[i] not in reference), i + k
    return n, unknown


def slow_language(text, references):
    if not any(c.isalpha() for c in text or ""):
        return "und"
    cost = {}
    for lang, reference in references.items():
        n, unknown = slow_phrases(text, reference)
        cost[lang] = (n - unknown) * math.log2(max(2, len(reference))) + unknown * langid.UNKNOWN_BITS
    return min(cost, key=lambda x: (round(cost[x] / len(text), 9), -len(references[x]), x))


SCRIPTS = {
    "zh": "我们一起学习中文。今天天气很好,他们在公园里散步。中国的首都是北京,上海是最大的城市。这本书是我朋友写的。",
    "ja": "私たちは一緒に日本語を勉強します。今日は天気がとても良いです。東京は日本の首都です。この本は友達が書きました。",
    "ko": "우리는 함께 한국어를 공부합니다. 오늘은 날씨가 아주 좋습니다. 서울은 한국의 수도입니다. 이 책은 친구가 썼습니다.",
    "th": "เราเรียนภาษาไทยด้วยกัน วันนี้อากาศดีมาก กรุงเทพเป็นเมืองหลวงของประเทศไทย หนังสือเล่มนี้เพื่อนของฉันเขียน",
    "hi": "हम साथ में हिन्दी सीखते हैं। आज मौसम बहुत अच्छा है। दिल्ली भारत की राजधानी है। यह किताब मेरे दोस्त ने लिखी है।",
    "ru": "Мы вместе учим русский язык. Сегодня очень хорошая погода. Москва столица России. Эту книгу написал мой друг.",
    "el": "Μαθαίνουμε μαζί ελληνικά. Σήμερα ο καιρός είναι πολύ καλός. Η Αθήνα είναι η πρωτεύουσα της Ελλάδας.",
    "ar": "نحن نتعلم اللغة العربية معا. الطقس جميل جدا اليوم. القاهرة هي عاصمة مصر. هذا الكتاب كتبه صديقي.",
    "en": "We learn English together. The weather is very good today. London is the capital of England. My friend wrote this book.",
    "de": "Wir lernen zusammen Deutsch. Das Wetter ist heute sehr gut. Berlin ist die Hauptstadt von Deutschland. Mein Freund schrieb dieses Buch.",
}


def test_scripts_are_told_apart(monkeypatch):
    lower = {k: v.lower() for k, v in SCRIPTS.items()}
    for dense in (63, 3):
        monkeypatch.setattr(langid, "DENSE", dense)
        parser = langid.CrossParser(lower)
        texts = ["我们学习", "日本の本を書きました", "날씨가 좋습니다", "วันนี้อากาศดี", "मौसम अच्छा है", "погода хорошая", "ο καιρός", "الطقس جميل", "the weather", "das Wetter", "½ ² Ⅷ", "", None, "ⴰⴱⴳ"]
        langs, scores = parser.predict(texts)
        assert langs[:10] == list(SCRIPTS) and langs[10:13] == ["und"] * 3 and scores[10:13] == [0.0] * 3
        assert langs == [slow_language(t, lower) for t in texts] and all(0 <= x <= 1 for x in scores)
    assert langs[13] == max(lower, key=lambda x: (len(lower[x]), x)) and scores[13] == 0.5  # equal everywhere: the longest reference


def test_ties():
    parser = langid.CrossParser({"b": "xyz", "a": "xyz", "c": "xy"})
    assert parser.predict(["qq", "xyz"])[0] == ["a", "a"]


def test_phrases_equal_greedy_longest_matches(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW", 16)
    references = {"a": "the cat sat on the mat", "b": "el gato en la mesa ñandú"}
    texts = ["the mat", "gato en el", "zzz the", "x", "that cat, la mesa zz", "ñandú " * 40, "", "the cat sat on the mat " * 9]
    for dense in (63, 4, 0):
        monkeypatch.setattr(langid, "DENSE", dense)
        n, unknown = langid.CrossParser(references).phrases(texts)
        assert [list(zip(a, b)) for a, b in zip(n.tolist(), unknown.tolist())] == [[slow_phrases(t, references[x]) for x in "ab"] for t in texts]


def test_query_equals_brute_force_on_all_documents(spark, docs):
    learned = langid.labelled_sample(docs, fold("doc_id", 3) != 1, text_col="text", lang_col="lang")
    rows = {r["doc_id"]: r["lang_pred"] for r in op3_language_id(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    assert all(rows[d] == slow_language(t, learned) for d, t in texts.items())


def test_sample_counts_copies_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 3)
    df = spark.createDataFrame([(i, "the same text" if i < 50 else f"text {i}", "en") for i in range(55)], "doc_id long, text string, lang string")
    got = langid.labelled_sample(df, F.lit(True), text_col="text", lang_col="lang")["en"].split("\n")
    assert len(got) == len(set(got)) == 3


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the cat", 5, "x", True)], "doc_id long, text string, score long, Lang_Pred string, _h boolean")
    got = langid.identify(df, {"en": "the cat sat"})
    assert got.columns == ["doc_id", "text", "_h", "lang_pred", "score"] and got.first()["lang_pred"] == "en"
    assert langid.identify(df, {"en": "the cat sat"}, keep=True).collect() == df.collect()


def test_held_out_accuracy(spark):
    df = op3_language_id(spark, "/root/testdata/sf0.01")
    gold = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(gold, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97


def test_odd_documents(odd, none):
    learned = langid.labelled_sample(odd, F.col("doc_id") < 8, text_col="text", lang_col="lang")
    assert set(learned) == {"en", "de"}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, learned).collect()}
    assert got[1] == "en" and got[6] == "de" and {i for i, x in got.items() if x == "und"} == {3, 4, 5, 7}
    kept = langid.identify(odd, learned, keep=True)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 4
    assert langid.identify(none, learned).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def slow_contained(docs, items, width=5, least=0.8):
    out = []
    for i, q in items:
        w = (q or "").encode().lower().split()
        k = min(width, len(w))
        if not k:
            continue
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, t in docs:
            x = (t or "").encode().lower().split()
            n = len(own & {tuple(x[j : j + k]) for j in range(len(x) - k + 1)})
            if n >= least * len(own) - 1e-9:
                out.append((str(d), i, n, len(own)))
    return sorted(out)


def test_containment_equals_brute_force(spark, docs):
    base = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = ROWS[7][1].split()
    items = [(1, " ".join(words[100:140])), (2, " ".join(words[100:120] + ["x"] + words[121:160])), (3, "The QUICK brown"), (4, ""), (5, None), (6, "nowhere to be found in any of them"), (7, " ".join(words[5:10])), (8, " ".join(words[300:310] + ["y"] + words[311:330]))]
    df = spark.createDataFrame([(r[0], r[1]) for r in ROWS] + base, "doc_id long, text string")
    got = decontam.contained_items(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["n_shared"], r["n_item"]) for r in got) == slow_contained([(r[0], r[1]) for r in ROWS] + base, items)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_of_items(spark, monkeypatch, odd, none, block):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    items = spark.createDataFrame([(i, ROWS[0][1]) for i in range(4)], "item_id long, text string")
    assert decontam.contained_items(odd, items).count() == 12
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3
    assert decontam.contained_items(none, items).count() == 0 and decontam.contained_items(odd, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(odd, items.limit(0)).count() == len(ROWS) and decontam.drop_contaminated(none, items).count() == 0
