from __future__ import annotations

import pytest
from pyspark.sql import types as T

from trustlens.llm.common import ship_code

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session", autouse=True)
def shipped():
    ship_code()


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text[, lang[, source]]) rows; extra names clash with internal ones."""

    def make(rows, extra=()):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *("en", "s")[len(r) - 2 :])[:4]
            full.append((doc_id, text, lang, source, len(text or "")))
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in extra:
            df = df.selectExpr("*", f"'clash' AS {name}")
        return df

    return make
