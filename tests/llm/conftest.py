import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import prose  # noqa: E402

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType()),
                     T.StructField("score", T.IntegerType()), T.StructField("words", T.StringType())])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, odd characters;
    columns whose names clash with those that operators make."""
    base = prose(1, 200)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, base), (6, base), (7, base.upper()),
            (8, base.replace("the", "a", 1)), (9, prose(2, 30_000)), (None, base), (None, None), (None, "lonely row " * 3),
            (10, "tab\there  two spaces   line"), (11, "漢字 кириллица 😀 é́ ▁ <|endoftext|> \u0000 end"),
            (12, "x" * 50_000), (13, prose(3, 60)), (13, prose(3, 60)), (14, "a b c d"), (15, "A B C D"),
            (16, "\n".join(["same line of text here"] * 40)), (17, "### $$$ %%% &&& *** " * 30)]
    return [(i, t, ["en", None, "xx", "de"][k % 4], "clash", k, "w") for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
