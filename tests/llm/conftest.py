import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x string"


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, an
    extra column, and columns whose names the operators use themselves."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (1, None, "en", "s1", 0, "a"), (2, "", "en", "s1", 0, "b"), (3, " \t\n", None, None, 3, None),
        (4, word * 3000, "en", "s2", None, "c"), (4, word * 3000, "en", "s2", None, "c"), (5, word * 3000, "en", None, 1, "c"),
        (None, "no id here at all, but words", "en", "s1", 5, "d"), (7, "123 456 !!!", "de", "s1", 5, "d"),
        (8, "der die das und nicht ein zu auf für", "de", "s3", 9, "e"), (9, "one two", "en", "s3", 9, "e"), (10, "ONE two", None, "s3", 9, "e"),
    ]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in ("n", "score", "kept", "row", "rank", "tokens", "copies_", "size", "id", "h", "_score", "_lang"):
        df = df.withColumn(name, df["x"])
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
