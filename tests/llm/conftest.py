import pytest

from sparkassay.session import ship_package


@pytest.fixture(scope="session")
def llm(spark):
    ship_package(spark)
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood for good"


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls in every column, empty and long texts, ties, repeated rows, one id with two texts."""
    long = "\n".join(f"line number {i} of a long text about the weather" for i in range(3000))
    rows = [
        (1, A, "en", "s0", 88), (2, A, "en", "s0", 88), (2, A, "en", "s0", 88), (3, None, None, None, None), (4, "", "en", "s1", 0),
        (5, long, "en", "s1", 9), (6, "  \t \n\n ", "de", None, 5), (7, A + "\nunder the MIT License", "fr", "s0", 100),
        (None, A, "en", "s0", 88), (8, "two texts with one id, the first of them is this one here", "en", "s2", 1),
        (8, "two texts with one id, the second of them is that one there", "en", "s2", 1), (9, "ÄÖÜ 你好 short", "de", "s2", 9),
    ]
    return llm.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)
