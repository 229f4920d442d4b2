import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, _key_a long, n_hit int"


@pytest.fixture
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns named like results."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six", "en", "a", 27, 0.5, 7, 1, 2),
        (1, "one two three four five six", "en", "a", 27, 0.5, 7, 1, 2),
        (1, "another text under the same id", "en", "a", 30, None, None, None, None),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "b", 0, 0.1, 1, 1, 1),
        (4, " \t\n ", "en", None, 4, 0.1, 1, 1, 1),
        (None, "a row without an id a@b.cd", "fr", "b", 20, 0.1, 1, 1, 1),
        (None, None, None, None, None, None, None, None, None),
        (5, long, "en", "a", len(long), 0.1, 1, 1, 1),
        (6, "é ü 😀 mail x@y.zz token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "de", "c", 5, 0.1, 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def odd_labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (2, None, 1), (3, 0, None), (None, 1, 1), (5, 1, 1), (6, 0, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
