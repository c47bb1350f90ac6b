"""Small tables for the operators that prepare training data."""

from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts; ids count from 0 unless given."""
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCUMENTS).repartition(3)

    return make


@pytest.fixture
def odd(documents, spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
    df = documents([None, "", " \n\t", "one two three", "one two three", long, "x" * 300_000, "été naïve 中文 <|endoftext|> it's\n\nok"], [1, 2, 3, 4, 4, 6, None, 8])
    return df.selectExpr("*", "1 as score", "'c' as component_id", "2 as n_tokens", "3 as n_lines", "true as kept", "5 as batch")
