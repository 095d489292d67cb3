import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, score double, rep long, kept string, words array<string>"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators use inside."""

    def make(*pairs):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", 0.5, 7, "x", ["a"]) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Null and empty texts, white space, ties, repeated rows and a very long text."""
    long = " ".join(f"w{k % 997}x{k}" for k in range(40_000))
    same = " ".join(f"tie{k}" for k in range(80))
    return make_docs((1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, same), (5, same), (5, same), (6, long), (7, "ß 漢字 😀 <|endoftext|> a\\b"), (8, "one two three"))


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], SCHEMA)
