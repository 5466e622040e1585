from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    from veilframe.llm import common

    return common.table(spark, SF, "documents")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank, wordless and very long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 977} tail{i % 31}" for i in range(30_000))
    passage = "the quick brown fox jumps over the lazy dog while nobody in the quiet town looks at it at all today"
    data = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, " \n\t ", "en", "a", 4), (4, "!!! 123 ???", "en", "b", 11), (5, long, "en", "a", len(long)), (6, long, "en", "a", len(long)), (7, passage, "en", None, 1), (7, passage, "en", None, 1),
        (8, f"{passage} and more words follow here", None, "a", 2), (9, "é日本 🎉 <|endoftext|> ﬁ", "fr", "a", 9), (None, passage, "en", "a", 3), (10, "one two three", "en", "a", 13), (11, "One TWO three", "en", "a", 13), (12, "x" * 5000, "de", "a", 5000),
    ]
    df = spark.createDataFrame(data, COLUMNS)
    for name in ("score", "predicted", "tkey", "token", "n", "spans", "rejected"):
        df = df.selectExpr("*", f"'kept' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
