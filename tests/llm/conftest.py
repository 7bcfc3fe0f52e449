import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, and columns with names that operators use inside."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, LONG, "en", "a"), (5, "one", "en", None), (5, "one", "en", None),
        (6, "The same text twice in this small table of rows, with enough words to be judged and to be compared by all of the rules that there are.", "en", "b"),
        (7, "The same text twice in this small table of rows, with enough words to be judged and to be compared by all of the rules that there are.", "en", "b"),
        (None, "a row without an id, which has a text of its own that nobody else has", "en", "b"), (None, None, None, None),
        (8, "été déjà vu 漢字 текст 12345", None, "c"), (9, "ONE TWO", "fr", "c"),
    ]
    schema = "doc_id long, text string, lang string, source string, "
    clash = "copy string, n int, key string, block int, part int, id string, sketch string, rejected_by string, score double, row int, `steps` int, pii_counts int, host string"
    values = [(*r, "x", 1, "k", 0, 0, "i", "s", "r", 0.5, 1, 2, 3, "h") for r in rows]
    return spark.createDataFrame(values, schema + clash)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
