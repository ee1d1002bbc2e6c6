import os

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, size long, copies int, words string, rank double, h long"
LONG = " ".join(f"word{i % 997} filler{i % 31}," for i in range(40_000))


def document(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, 1, 7, 7, "clash", 0.5, 3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [
        document(1, None), document(2, ""), document(3, " \t\n"), document(4, "one two three four five six"),
        document(5, LONG, "s1"), document(6, "same text here", None), document(6, "same text here", None),
        document(7, "A a b é <|endoftext|> c\x1cd 中文 x\n\n  y"), document(8, "same text here", "s2"),
        document(9, ("all in one row of words " * 40).strip(), "s2"), document(10, "line\nline\nline\n\nother line", ""),
        document(None, "no id", "s3"), document(11, "tail" + " " * 50, "s1"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{os.environ.get('TESTDATA_DIR', '/root/testdata')}/sf0.001/documents.parquet")
