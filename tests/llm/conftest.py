import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(text, ...) -> a documents table with ids 0, 1, ... in two partitions."""
    def build(*texts, lang="en"):
        rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(2) if rows else spark.createDataFrame([], SCHEMA)

    return build


ODD = [None, "", " ", "the cat", "the cat", "1234 --", "Ünïcode 日本語 🙂", "x" * 5000, "a b\x0bc\n\n d  e\t", "word " * 3000, "<|endoftext|> it's"]


@pytest.fixture
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def corpus():
    return "/root/testdata/sf0.001"
