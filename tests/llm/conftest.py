import pytest

#: Documents with nulls in every column, empty and long texts, ties, repeated rows, and columns named as operators name theirs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h long, kept boolean, row string"
LONG = " ".join(f"wort{i % 5000}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 5, 9, 1, True, "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 5, 9, 1, True, "x"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 5, 9, 1, True, "x"),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", None, 0, None, None, None, None),
    (5, "  \n ", None, "s", 3, 1, 1, False, ""),
    (None, "kein Text ohne Kennung", "de", "s", 1, 1, 1, True, "y"),
    (6, LONG, "de", "s", len(LONG), 1, 1, True, "z"),
    (7, "12345 67890 !!! ***", "en", "s", 1, 1, 1, True, "z"),
    (8, "Ünïcode 日本語 <|endoftext|> </s> é \x00 end", "fr", "s", 1, 1, 1, True, "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SF = "/root/testdata/sf0.001"

#: Columns named as operators name theirs, and text ids.
CLASHES = ["_h", "_at", "_suspect", "_id", "_digest", "_row", "_hot", "_first", "score", "lang_pred", "id", "h", "d", "i", "group", "block", "more", "full_hash", "a.b", "row"]


@pytest.fixture(scope="session")
def clashing(spark):
    schema = "doc_id string, text string, lang string, source string, " + ", ".join(f"`{c}` boolean" for c in CLASHES)
    rows = [(None if r[0] is None else f"id{r[0]}", *r[1:4], *((k + j) % 3 == 0 for j in range(len(CLASHES)))) for k, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema).repartition(3)
