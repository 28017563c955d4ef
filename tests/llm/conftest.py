import pytest


@pytest.fixture()
def odd_docs(spark):
    """Nulls, blanks, repeated rows, a long text and columns whose names the
    operators use themselves."""
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one word", "en", "a"),
            (4, "one word", "en", "a"), (5, "lorem ipsum " * 40_000, "de", "b"), (None, "one word", "en", "a"),
            (6, "ÄÖ ß\x00   \U0001f600 x", "de", "b")]
    names = ("score", "hits", "hits_0", "pii", "secrets", "words", "row", "id", "fp", "comp", "weight", "language",
             "tokens_topic", "cell_lang", "toxicity", "head", "text_", "hash")
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
