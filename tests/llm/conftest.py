import pytest

#: Nulls, empty and long texts, ties, repeated rows, extra columns with names that operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, k long, h string, recipe string, chunks string, kept string, score string, pos long, y int"


def row(doc_id, text):
    return (doc_id, text, None, "s", len(text or ""), 1, "h", "r", "c", "kept", "x", 7, 1)


@pytest.fixture(scope="session")
def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = [(0, None), (1, ""), (2, "Alpha beta"), (3, "alpha BETA"), (3, "alpha BETA"), (4, long), (5, long.upper()), (None, "alpha beta"), (6, "\n\n"), (7, "É b"), (8, "é b"), (9, "  \t "), (10, "a b c d"), (11, "A b c d")]
    return [row(*t) for t in texts]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, EXTRA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
