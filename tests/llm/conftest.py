from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs; the other columns are filled in."""

    def make(pairs, source="s"):
        return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in pairs], DOCS)

    return make


ODD_TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "naïve ▁ mark", "日本語 テキスト", "😀 \x00 z",
             "word " * 4000, "x" * 5000, "<|endoftext|> <s>", "same text here", "same text here"]
