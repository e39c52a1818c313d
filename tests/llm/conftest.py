import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers import the package by path
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

SF = "/root/testdata/sf0.01"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and odd texts, repeated rows and extra columns whose names clash."""
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    prose = "the quick brown fox jumps over the lazy dog near the river bank and runs away from the big bear " * 4
    rows = [
        (1, prose, "en", "s", 1, 5, "a"), (1, prose, "en", "s", 1, 5, "a"), (2, prose, "en", "s", 1, 5, "b"),
        (3, None, "en", "s", None, None, None), (4, "", None, None, 0, 0, "c"), (5, " \n\t ", "fr", "s", 4, 1, "c"),
        (None, "no id here " * 20, "en", "s", 1, 1, "d"), (None, None, None, None, None, None, None),
        (6, long_text, "en", "s", 1, 1, "e"), (7, "12345 #### 67", "en", "s", 1, 1, "f"), (8, "Licensed under the MIT License.", None, "s", 1, 1, "g"),
        (9, "x", "de", "s", 1, 1, "h"), (1, "another text under the same id", "en", "s", 1, 1, "i"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, words string")


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
