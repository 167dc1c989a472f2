from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, an id with two texts, clashing extra columns."""
    long = " ".join(random.Random(1).choices(["alpha", "beta", "gamma", "delta", "omega"], k=60_000))
    rows = [
        (1, "The cat sat on the mat and looked at the dog for a while.", "en", "a", 57), (1, "The cat sat on the mat and looked at the dog for a while.", "en", "a", 57),
        (2, None, "en", "a", None), (3, "", None, None, 0), (4, "   \n\t ", "en", "b", 6), (None, "A text without a number of its own, call +1 (212) 555-0187 now.", "en", "b", 60),
        (None, None, None, None, None), (5, long, "en", "c", len(long)), (6, "word", "de", "c", 4), (7, "!!!", "fr", "c", 3), (8, "Ünïcödé 你好 😀 text", "es", None, 18),
        (9, "one text of this id with several words in it", "en", "d", 44), (9, "quite another text that has the same identifier", "en", "d", 47),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({"quality": F.lit("x"), "_gone": F.lit(1), "label": F.lit(None).cast("int"), "bands": F.lit(2.0), "item_id": F.lit(3)})
