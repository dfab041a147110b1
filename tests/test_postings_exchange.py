"""Postings are counted where their document is: no term goes through an exchange to be counted."""

from __future__ import annotations

from sessionlens.operators import postings as P
from sessionlens.operators import retrieval as R


def exchanged(spark) -> int:
    """Rows that all stages so far gave to exchanges."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_term_is_exchanged(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * k % 97}" for k in range(80))) for i in range(200)] + [(900, None), (901, "")], "id long, text string")
    before = exchanged(spark)
    got = R.postings(docs, "id", "text").collect()
    assert exchanged(spark) - before < 1000 < len(got)
    assert all(r["dl"] == 80 for r in got) and sum(r["tf"] for r in got) == 200 * 80
    assert len({(r["doc"], r["term"]) for r in got}) == len(got)


def test_texts_are_split_into_words_once(spark, tmp_path, monkeypatch):
    """Statistics of the whole segment come with the postings; segments without a word have them, too."""
    calls, tokens = [], P.T.tokens
    monkeypatch.setattr(P.T, "tokens", lambda text: calls.append(1) or tokens(text))
    of = lambda rows: spark.createDataFrame(rows, "k long, t string")
    segments = [[(1, "a b a"), (2, None), (3, "c")], [(4, ""), (5, None)], [], [(6, "d d d d")]]
    P.written(of(segments[0]), "k", "t", f"{tmp_path}/index")
    for more in segments[1:]:
        P.added(of(more), "k", "t", f"{tmp_path}/index")
    got = P.stats(spark, f"{tmp_path}/index")
    assert (got["n"], got["avgdl"]) == (6, 8 / 6)
    assert len(calls) == len(segments)
    P.written(of([]), "k", "t", f"{tmp_path}/none")
    assert (P.stats(spark, f"{tmp_path}/none")["n"], P.stats(spark, f"{tmp_path}/none")["avgdl"]) == (0, None)
