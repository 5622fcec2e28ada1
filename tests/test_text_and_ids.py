from pyspark.sql import functions as F

from papertrail.functions import geo, ids, text, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_digits_and_normal_form(spark):
    assert one(spark, text.fold_digits(F.lit("१२ ౩౪ ５６ 7"))) == "12 34 56 7"
    assert one(spark, text.nfc(F.lit("é"))) == "é"
    assert text.normalize_query_text("  Hi, नमस्‍ते! a@b #5५ 🙂") == "hi नमस्ते a@b 55 🙂"


def test_words_and_jaccard(spark):
    a, b = text.word_set(F.lit("The cat, the hat a")), text.word_set(F.lit("the HAT"))
    assert one(spark, a) == ["the", "cat", "hat"]
    assert abs(one(spark, text.jaccard(a, b)) - 2 / 3) < 1e-12
    empty = text.word_set(F.lit("a b"))
    assert one(spark, text.jaccard(empty, empty)) == 1.0
    assert one(spark, text.query_terms(F.lit("show me the PAN card, pan x"))) == ["pan", "card"]


def test_edit_distance():
    assert text.osa_distance("abc", "acb", 1) == 1
    assert text.osa_distance("kitten", "sitting", 3) == 3
    assert text.osa_distance("kitten", "sitting", 2) == 3
    assert text.osa_distance("", "ab", 2) == 2


def test_json_and_replies(spark):
    assert text.first_json_object('x {"a": "}\\"{", "b": {"c": 1}} y') == '{"a": "}\\"{", "b": {"c": 1}}'
    assert text.first_json_object("none {") is None and text.first_json_object(None) is None
    assert one(spark, text.tidy_reply(F.lit('Assistant: "fine"'))) == "fine"


def test_scripts(spark):
    assert one(spark, text.scripts(F.lit("नमस्ते దోస్త్ hello world"))) == ["latin", "devanagari", "telugu"]
    assert one(spark, text.scripts(F.lit(""))) == []


def test_verhoeff(spark):
    assert one(spark, ids.verhoeff_valid(F.lit("234123412346"))) and not one(spark, ids.verhoeff_valid(F.lit("234123412345")))
    assert one(spark, ids.check_digit(F.lit("23412341234"))) == 6
    assert one(spark, ids.aadhaar_valid(F.lit("234123412346"))) and not one(spark, ids.aadhaar_valid(F.lit("134123412346")))
    assert not one(spark, ids.verhoeff_valid(F.lit("12a")))


def test_masks(spark):
    said = "id 2341 2341 2346, account 234123412345, card 2341234123462222"
    assert ids.mask_in_text(said) == "id XXXX XXXX 2346, account 234123412345, card 2341234123462222"
    assert one(spark, ids.mask_aadhaar_in(F.lit(said))) == ids.mask_in_text(said)
    assert one(spark, ids.mask_aadhaar_in(F.lit(None).cast("string"))) is None
    assert one(spark, ids.mask_last4(F.lit("ABCDE1234F"))) == "XXXXXX234F"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vectors.dot(a, b)) == 24 and one(spark, vectors.dot(a, F.array(F.lit(1.0)))) is None
    assert abs(one(spark, vectors.cosine(a, b)) - 0.96) < 1e-12
    assert one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vectors.l2_normalize(a)) == [0.6, 0.8]
    assert one(spark, vectors.mean_pool(F.array(a, b, a), F.array(F.lit(1), F.lit(1), F.lit(0)))) == [3.5, 3.5]
    assert abs(sum(one(spark, vectors.softmax(F.array(F.lit(1000.0), F.lit(999.0))))) - 1) < 1e-12


def test_geography(spark):
    km = one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert abs(km - 111.195) < 0.01
    assert one(spark, geo.day_bucket(F.lit(86_400_000 * 3 + 5))) == 3
