import pytest

WEIRD = [
    (1, None, "en", "s", 0, "x", 1.0),
    (2, "", "en", "s", 0, "x", 1.0),
    (3, " \n\t ", None, None, 3, None, None),
    (4, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (5, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (5, "the cat sat on the mat and looked at the dog for a while", "en", "s", 1, "x", 1.0),
    (6, "der hund lief über die straße und sah die katze am haus", "de", "s", 1, "x", 1.0),
    (7, "a" * 30_000, "en", "s", 1, "x", 1.0),
    (8, "word " * 20_000, "en", "s", 1, "x", 1.0),
    (9, "12345 67890 !!! ???", None, "s", 1, "x", 1.0),
    (10, "日本語の文章です。 <|endoftext|> ▁▁ \x00 \r\n\r\n  end", "ja", "s", 1, "x", 1.0),
    (None, "a row without an id, but with a text of its own to look at", "en", "s", 1, "x", 1.0),
    (11, "line one is here for all to see\nline two is here for all to see\n\nline one is here for all to see", "en", "s", 1, "x", 1.0),
    (12, "line one is hero for all to see\nshort", "en", "s", 1, "x", 1.0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, score double"


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    return spark.createDataFrame(WEIRD, SCHEMA)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(4, 1, 0), (5, 1, None), (5, 1, 1), (None, 1, 1), (99, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
