from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd_texts():
    """Null, empty, blank, one word, very long, repeated and not plain ASCII."""
    return [None, "", " \n\t ", "word", "a b c " * 20_000, "The same text.", "The same text.", "Ünï cödé 漢字 😀 x", "x" * 30_000, "\n\n", "A B C D E F G H I J K L M N"]


@pytest.fixture
def odd_docs(spark, odd_texts):
    """The odd texts with null and repeated ids, and extra columns under names that operators use inside."""
    rows = [(None if i == 3 else 5 if i in (5, 6) else i, t) for i, t in enumerate(odd_texts)] + [(None, "The same text.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ("fp", "component_id", "score", "n_hit", "hits", "ids", "spans", "_key", "label", "line", "a", "b", "node", "root")
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")
