"""A stemmed search stems each term of the corpus once, however many documents have it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from sessionlens.functions import text as T
from sessionlens.operators import retrieval as R


def test_each_term_is_stemmed_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(term):
        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            seen.add(len(s))
            return s.str.removesuffix("s")

        return run(term)

    monkeypatch.setattr(T, "stemmed", counted)
    monkeypatch.setattr(T, "_stem", lambda t: t.removesuffix("s"))
    docs = spark.createDataFrame([(i, "models model old words" if i % 2 else "old word words words") for i in range(300)] + [(400, None)], "id long, text string")
    got = R.bm25(docs, "id", "text", "model", 400, stem=True).collect()
    assert [r["id"] for r in got] == list(range(1, 300, 2)) and len({r["score"] for r in got}) == 1
    assert seen.value <= 2 * 5
