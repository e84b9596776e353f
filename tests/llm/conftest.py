import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with a null or blank text, ties, repeats, odd characters, and columns with clashing names."""

    def make(texts, extra=True):
        rows = [(i, t, "en" if i % 2 else None, "s", 1, "x", 2) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score string, n long")
        return df if extra else df.select("doc_id", "text")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [None, "", " \n\t ", "a", "one two three four", "é à 日本語 😀", "word " * 3000, "same text here again", "same text here again", "a▁b  c\x00d", "\n\n", "A" * 20_000]
