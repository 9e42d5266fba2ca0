import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, block int, size long, sid string, epoch int, id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless, very long and repeated texts, equal ids, extra columns with clashing names."""
    prose = " ".join(f"word{i % 90} the of {i % 7}" for i in range(200))
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, None, None, None), (4, "", "en", ""), (5, " \t\n ", "fr", "b"),
        (6, "one", "fr", None), (7, prose + " end", "en", "b"), (None, prose, None, "b"), (None, None, None, None), (8, "Ä é ß 日本", "de", "c"),
        (9, "token " * 30_000, "en", "c"), (10, "x" * 200_000, "en", "c"), (11, "a@b.com, +1 (555) 123-4567, 10.0.0.1, 4111 1111 1111 1111", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, None, "s", 3, "x") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
