import os

import pandas as pd
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, and columns with names that operators might use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30000))
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "same text here " * 10, "en", "a"),
        (4, "same text here " * 10, "en", "a"), (4, "other text, same id", "fr", "b"), (None, "no id at all " * 5, "en", "a"),
        (5, long, "en", "a"), (6, long, "en", "a"), (7, "é" * 300 + " ünï " * 50, "fr", "b"), (8, "AKIA" + "A" * 16 + " password=abcdefgh1", "en", "b"),
    ]
    rows = [(*r, 7, "k", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n int, k string, length double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
