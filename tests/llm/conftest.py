import pytest

LONG = "word and word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1.0, 7, "x"),
        (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a", 1.0, 7, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "b", 0.5, 0, ""),
        (4, " \n\t ", "fr", "b", 0.5, 0, "y"),
        (5, LONG, "en", "b", 0.5, 0, "y"),
        (None, "no id here but some words in it", "en", None, 0.1, 1, "z"),
        (6, "été déjà vu à la plage 🙂 漢字", "fr", "c", 0.2, 2, "z"),
        (7, "1234 !!! 5678", None, "c", 0.2, 2, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, n long, spans string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
