import pytest

SMALL = "/root/testdata/sf0.001"

LONG = "word " * 30_000 + "x" * 5_000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, clashing extra columns."""
    rows = [(1, "the cat sat on the mat", "en", "a", 22), (1, "the cat sat on the mat", "en", "a", 22), (2, None, None, None, None),
            (3, "", "en", "a", 0), (None, "the cat sat on the mat", "en", None, 22), (None, None, None, None, None),
            (4, LONG, "en", "b", len(LONG)), (5, " \n\t ", "en", "b", 4), (6, "é漢😀 <s> <|endoftext|> \x00", "de", "b", 22),
            (4, "another text with the id of the long one", "en", "b", 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("n_words", "fp", "_row", "shard", "score", "kept", "spans", "length", "ids", "pid", "host", "n_tokens"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
