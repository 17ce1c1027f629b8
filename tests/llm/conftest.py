"""Documents that hold every odd case, and a session shared with the other tests."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id string, score double, rid long"
LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, repeated rows, a long text, columns of clashing names."""
    texts = [
        (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, " \n\t "), (6, LONG),
        (None, "one two three four five six"), (None, None), (7, "a\nb\nc\nd"), (7, "a\nb\nc\nd"), (8, "x\na\nb\nc"), (9, "été ÉTÉ 東京 🙂"),
    ]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z", 1.0, 5) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def text_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}
